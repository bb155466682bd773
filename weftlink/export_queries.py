"""Queries of the exports in full, of the older matcher and snapshots, and of revisions, with their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.more_queries import POLICY, Work, add
from weftlink.operators import baseline, decide, review, survive
from weftlink.plans import oracle as O
from weftlink.plans.entities import MAPPINGS
from weftlink.sources import layouts
from weftlink.sources.revisions import Repository, RevisionConflict
from weftlink.sources.tables import shared_folder

VERSIONS = layouts.Versions("matcher-1", "candidates-4", "mapping-1", "source-a", "source-b", POLICY.version)
_MERGE = [m for m in MAPPINGS if m.merge]


def _shared(w: Work, name: str, make) -> DataFrame:
    if name not in w.__dict__:
        w.__dict__[name] = w.m._shared(make())
    return w.__dict__[name]


# The reconciliation table


def _raw(m, s: str) -> str:
    return f"coalesce({'x' if s == 'a' else 'y'}.{m.a_column if s == 'a' else m.b_column}, '')"


_STRATEGY = {f.mapping_id: f.strategy for f in POLICY.fields}
_RULE_ID = {f.mapping_id: POLICY.rule_id(f.mapping_id) for f in POLICY.fields}


def _field_sql(m) -> str:
    i = m.mapping_id
    settled = f"CASE r_{i}.chosen WHEN 'A' THEN r_{i}.a_value WHEN 'B' THEN r_{i}.b_value ELSE r_{i}.a_value || ' | ' || r_{i}.b_value END"
    na = ["''", "''", "''", "CASE WHEN kind IN ('review', 'deferred') THEN 'pending_identity' ELSE 'not_applicable' END", "''"] + ["CASE kind WHEN 'different' THEN 'identity_different' WHEN 'only_a' THEN 'source_only_a' WHEN 'only_b' THEN 'source_only_b' ELSE 'unresolved' END"] * 2
    na += ["CASE kind WHEN 'different' THEN 'Human review determined that these records are different entities.' WHEN 'deferred' THEN 'Identity review was explicitly deferred.' WHEN 'review' THEN 'Identity is not resolved.' ELSE 'No cross-source conflict.' END", "''", "''"]
    done = [settled, f"r_{i}.conflict_id", f"'resolution-' || r_{i}.conflict_id", "'resolved'", f"'{_STRATEGY.get(i, '')}'", "'rule'", "'deterministic_rule'", f"r_{i}.reason", f"'{POLICY.version}'", f"'{_RULE_ID.get(i, '')}'"]
    open_ = ["''", f"r_{i}.conflict_id", "''", "'unresolved'", "''", "'unresolved'", "'unresolved'", "'No survivorship decision has been applied.'", "''", "''"]
    equal = [_raw(m, "a"), "''", "''", "'agreed'", "'agreed'", "'equal_sources'", "'source_equality'", "'Source values are equal.'", "''", "''"]
    case = lambda k: f"CASE WHEN kind <> 'linked' THEN {na[k]} WHEN r_{i}.chosen IS NOT NULL THEN {done[k]} WHEN r_{i}.conflict_id IS NOT NULL THEN {open_[k]} ELSE {equal[k]} END"
    return ", ".join(f"{case(k)} AS {n}_{i}" for k, n in enumerate(layouts.PER_FIELD))


_PAIR = "candidate_id, a_row_id, b_row_id, score, collision"
_LAYOUT_SQL = f""", opened AS (SELECT * FROM items WHERE state IN ('needs_review', 'deferred') AND a_row_id NOT IN (SELECT a_row_id FROM links)),
rows AS (
  SELECT k.candidate_id, k.a_row_id, k.b_row_id, k.score, k.collision, 'same_entity' AS st, source AS src, CASE source WHEN 'human' THEN 'reviewed_same' ELSE 'system_established' END AS rv, 'linked' AS kind FROM links JOIN kept k USING (candidate_id)
  UNION ALL SELECT k.candidate_id, k.a_row_id, k.b_row_id, k.score, k.collision, 'different_entity', 'human', coalesce(i.state, 'reviewed_different'), 'different' FROM dec JOIN kept k USING (candidate_id) LEFT JOIN items i ON i.a_row_id = k.a_row_id WHERE decision = 'different_entity'
  UNION ALL SELECT k.candidate_id, k.a_row_id, k.b_row_id, k.score, k.collision, o.state, CASE o.state WHEN 'deferred' THEN 'human_defer' ELSE 'pending_human_review' END, o.state, CASE o.state WHEN 'deferred' THEN 'deferred' ELSE 'review' END FROM opened o JOIN kept k ON k.candidate_id = o.candidate_id
  UNION ALL SELECT '', row_id, '', NULL, false, 'only_a', 'none', 'source_only', 'only_a' FROM a WHERE row_id NOT IN (SELECT a_row_id FROM links) AND row_id NOT IN (SELECT a_row_id FROM opened)
  UNION ALL SELECT '', '', row_id, NULL, false, 'only_b', 'none', 'source_only', 'only_b' FROM b WHERE row_id NOT IN (SELECT b_row_id FROM links) AND row_id NOT IN (SELECT b_row_id FROM opened))
SELECT rows.a_row_id, rows.b_row_id, st AS identity_status, src AS identity_decision_source, '' AS identity_decision_id, '' AS identity_decided_at, rv AS review_state, rows.candidate_id, coalesce(CAST(score AS VARCHAR), '') AS match_score, CAST(rows.collision AS VARCHAR) AS collision,
  'matcher-1' AS matcher_version, 'candidates-4' AS candidate_engine_version, 'mapping-1' AS mapping_version, 'source-a' AS source_a_sha256, 'source-b' AS source_b_sha256, '{POLICY.version}' AS survivorship_policy_version, 'reconciliation-export-v3.0.0' AS export_version,
  {", ".join(f"{_raw(m, s)} AS {s}_{m.mapping_id}" for m in MAPPINGS for s in "ab")}, {", ".join(_field_sql(m) for m in _MERGE)}
FROM rows LEFT JOIN a_src x ON x.row_id = rows.a_row_id LEFT JOIN b_src y ON y.row_id = rows.b_row_id {" ".join(f"LEFT JOIN ruled r_{m.mapping_id} ON r_{m.mapping_id}.candidate_id = rows.candidate_id AND r_{m.mapping_id}.mapping_id = '{m.mapping_id}'" for m in _MERGE)}"""
add("snk01_layout", "survive", _LAYOUT_SQL, lambda w: layouts.reconciliation_layout(w.m.a, w.m.b, w.m.kept, w.links, w.decisions, w.items, w.previewed, MAPPINGS, VERSIONS, POLICY))

# The trusted table, of a state where all is settled: what nobody has confirmed is different, what no rule settles is A's


def _settled(w: Work) -> tuple[DataFrame, ...]:
    """(decisions, links, preview, readiness) once every open pair is rejected and every open conflict is resolved for A."""
    rest = w.m.kept.join(w.m.automatic.select("a_row_id"), "a_row_id", "left_anti").join(w.decisions.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", F.lit("different_entity").alias("decision"))
    decisions = _shared(w, "all_decided", lambda: w.decisions.unionByName(rest))
    links = _shared(w, "all_links", lambda: decide.checked_links(w.m.kept, w.m.automatic, decisions))
    found = survive.conflicts(survive.linked_values(links, w.m.a, w.m.b, MAPPINGS))
    ruled = survive.preview(found, POLICY, None, w.m.a, w.m.b)
    by_hand = ruled.where("chosen IS NULL").select("conflict_id", F.lit("A").alias("chosen"), F.lit("manual").alias("origin"))
    previewed = _shared(w, "all_previewed", lambda: survive.preview(found, POLICY, by_hand, w.m.a, w.m.b))
    items = review.queue(w.m.kept, w.m.automatic, decisions, w.deferrals.where("false"))
    return decisions, links, previewed, survive.readiness(items, previewed, decide.double_claims(links))


def _trusted(w: Work) -> DataFrame:
    decisions, links, previewed, ready = _settled(w)
    return layouts.trusted_layout(w.m.a, w.m.b, links, decisions, previewed, ready, MAPPINGS, VERSIONS, POLICY)


def _trusted_field(m) -> str:
    i = m.mapping_id
    x, y = _raw(m, "a"), _raw(m, "b")
    rule = f"r_{i}.chosen IS NOT NULL"
    pick = f"CASE coalesce(r_{i}.chosen, 'A') WHEN 'A' THEN {x} WHEN 'B' THEN {y} ELSE {x} || ' | ' || {y} END"
    alone = [f"CASE kind WHEN 'source_only_a' THEN {x} ELSE {y} END", x, y, "kind", "kind", "kind", "''", "''", "''", "'No cross-source conflict.'"]
    equal = [x, x, y, "'agreed'", "'equal_sources'", "'source_equality'", "''", "''", "''", "'Source values are equal.'"]
    held = [pick, x, y, f"CASE WHEN {rule} THEN '{_STRATEGY.get(i, '')}' ELSE 'use_a' END", f"CASE WHEN {rule} THEN 'rule' ELSE 'human' END", f"CASE WHEN {rule} THEN 'deterministic_rule' ELSE 'manual' END", f"'resolution-' || r_{i}.conflict_id",
            f"CASE WHEN {rule} THEN '{POLICY.version}' ELSE '' END", f"CASE WHEN {rule} THEN '{_RULE_ID.get(i, '')}' ELSE '' END", f"CASE WHEN {rule} THEN r_{i}.reason ELSE 'manual_preserved' END"]
    return ", ".join(f'CASE WHEN kind <> \'confirmed_cross_source\' THEN {alone[k]} WHEN r_{i}.conflict_id IS NOT NULL THEN {held[k]} ELSE {equal[k]} END AS "{i}{n}"' for k, n in enumerate(layouts.TRUSTED_FIELD))


# rejecting more pairs changes no link: the rejected are of A rows without an automatic one
add(
    "snk02_layout", "survive",
    f""", rows AS (SELECT candidate_id, a_row_id, b_row_id, 'confirmed_cross_source' AS kind, source FROM links UNION ALL SELECT '', row_id, '', 'source_only_a', 'none' FROM a WHERE row_id NOT IN (SELECT a_row_id FROM links) UNION ALL SELECT '', '', row_id, 'source_only_b', 'none' FROM b WHERE row_id NOT IN (SELECT b_row_id FROM links))
    SELECT kind AS entity_provenance, rows.a_row_id, rows.b_row_id, rows.source AS identity_source, '' AS identity_decision_id, 'mapping-1' AS mapping_version, 'source-a' AS source_a_sha256, 'source-b' AS source_b_sha256, 'candidates-4' AS candidate_engine_version, 'matcher-1' AS matcher_version,
      '{POLICY.version}' AS survivorship_policy_version, 'trusted-merged-export-v2.0.0' AS export_version, {", ".join(_trusted_field(m) for m in _MERGE)}
    FROM rows LEFT JOIN a_src x ON x.row_id = rows.a_row_id LEFT JOIN b_src y ON y.row_id = rows.b_row_id {" ".join(f"LEFT JOIN ruled r_{m.mapping_id} ON r_{m.mapping_id}.candidate_id = rows.candidate_id AND r_{m.mapping_id}.mapping_id = '{m.mapping_id}'" for m in _MERGE)}""",
    _trusted,
)

# Conflict pages

for _n, _status in enumerate(("all", "unresolved", "resolved")):
    _where = {"all": "true", "unresolved": "chosen IS NULL", "resolved": "chosen IS NOT NULL"}[_status]
    add(
        f"flt03_conflicts_{_status}", "survive", f"SELECT conflict_id, r.candidate_id, mapping_id, chosen, l.a_row_id, l.b_row_id FROM ruled r JOIN (SELECT candidate_id, a_row_id, b_row_id FROM links) l USING (candidate_id) WHERE {_where} ORDER BY conflict_id LIMIT 30 OFFSET 7",
        lambda w, status=_status: review.conflict_page(w.previewed, w.links, status, 7, 30).select("conflict_id", "candidate_id", "mapping_id", "chosen", "a_row_id", "b_row_id"),
    )

# The older matcher, snapshots and their comparison

_OLD = {m.mapping_id: {"text": O.text, "phone": lambda c: f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')", "email": lambda c: f"regexp_replace(lower(coalesce({c}, '')), '\\s+', '', 'g')"}[m.normalizer] for m in MAPPINGS}
_TEXTS = [m.mapping_id for m in MAPPINGS if m.normalizer == "text"]
_old_ratios = O.RATIOS
for _name in ("wanted", "ratio_in", "ratios", "seg"):


    _old_ratios = re.sub(rf"\b{_name}\b", f"old_{_name}", _old_ratios)


def _part(m) -> str:
    i = m.mapping_id
    alike = f"WHEN q_{i}.ratio >= 0.65 THEN q_{i}.ratio " if m.normalizer == "text" else ""
    return f"CASE WHEN a_{i} = '' OR b_{i} = '' THEN 0.0 WHEN a_{i} = b_{i} THEN 1.0 {alike}ELSE 0.0 END"


_BASE = f""", old_a AS MATERIALIZED (SELECT row_id, {", ".join(f"{_OLD[m.mapping_id](f'v_{m.mapping_id}')} AS n_{m.mapping_id}" for m in MAPPINGS)} FROM a), old_b AS MATERIALIZED (SELECT row_id, {", ".join(f"{_OLD[m.mapping_id](f'v_{m.mapping_id}')} AS n_{m.mapping_id}" for m in MAPPINGS)} FROM b),
old_valued AS MATERIALIZED (SELECT candidate_id, a_row_id, b_row_id, {", ".join(f"x.n_{m.mapping_id} AS a_{m.mapping_id}, y.n_{m.mapping_id} AS b_{m.mapping_id}" for m in MAPPINGS)} FROM pairs JOIN old_a x ON x.row_id = a_row_id JOIN old_b y ON y.row_id = b_row_id),
old_ratio_in AS ({" UNION ALL ".join(f"SELECT a_{i} AS x, b_{i} AS y FROM old_valued" for i in _TEXTS)}), {_old_ratios},
old AS MATERIALIZED (SELECT candidate_id, a_row_id, b_row_id, {O.six("(CAST(0 AS DOUBLE) + " + " + ".join(f"({_part(m)})" for m in MAPPINGS) + f") / {len(MAPPINGS)}")} AS score FROM old_valued {" ".join(f"LEFT JOIN old_ratios q_{i} ON q_{i}.l = a_{i} AND q_{i}.r = b_{i}" for i in _TEXTS)})"""


def _old(w: Work) -> DataFrame:
    return _shared(w, "old_ranked", lambda: decide.ranked(baseline.baseline_scored(w.m.pairs, *w.m.rows, MAPPINGS), baseline.BASELINE_RULES))


add("scr04_baseline_scores", "truth", f"{_BASE} SELECT candidate_id, a_row_id, b_row_id, score FROM old", lambda w: _old(w).select("candidate_id", "a_row_id", "b_row_id", "score"))
_OLD_RANKED = f"""{_BASE}, o1 AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt, max(score) OVER (PARTITION BY a_row_id) AS top FROM old WINDOW w AS (PARTITION BY a_row_id ORDER BY score DESC, b_row_id)),
o2 AS (SELECT *, CASE WHEN rank = 1 THEN {O.six("least(1.0, greatest(0.0, score - coalesce(nxt, 0.0)))")} ELSE 0.0 END AS margin, sum(CASE WHEN rank = 1 AND score >= 0.38 THEN 1 ELSE 0 END) OVER (PARTITION BY b_row_id) AS wanted FROM o1),
old_ranked AS MATERIALIZED (SELECT *, CASE WHEN rank = 1 AND score >= 0.82 AND margin >= 0.08 AND NOT (wanted > 1 AND score >= 0.38) THEN 'auto_match' ELSE 'needs_review' END AS band FROM o2),
old_kept AS MATERIALIZED (SELECT * FROM old_ranked WHERE top >= 0.38 AND score >= greatest(0.30, {O.six("top - 0.25")}) AND rank <= 3)"""


def _nine(ranked: str, kept: str) -> str:
    n = lambda of, where="true": f"(SELECT count(*) FROM {of} WHERE {where})"
    true = lambda of, where="true": n(f"{of} JOIN truth USING (a_row_id, b_row_id)", where)
    first = "rank = 1 AND band = 'auto_match'"
    theory = "(SELECT count(*) FROM a) * (SELECT count(*) FROM b)"
    rows = [
        (f"{theory} - {n(ranked)}", theory), (true(ranked), n("truth")), (true(ranked), true(ranked)), (true(kept), true(ranked)), (true(ranked, first), n(ranked, first)), (true(ranked, first), n("truth")),
        (f"(SELECT count(DISTINCT a_row_id) FROM {kept} WHERE a_row_id IN (SELECT a_row_id FROM truth) AND a_row_id NOT IN (SELECT a_row_id FROM {ranked} WHERE {first}))", "(SELECT count(DISTINCT a_row_id) FROM truth)"),
        (true(kept), n("truth")), (true(ranked, "rank = 1"), f"(SELECT count(DISTINCT a_row_id) FROM {ranked} JOIN truth USING (a_row_id, b_row_id))"),
    ]
    cells = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({x} AS BIGINT) AS numerator, CAST({y} AS BIGINT) AS denominator" for m, (x, y) in zip(baseline.METRICS, rows, strict=True))
    return f"SELECT *, CASE WHEN denominator > 0 THEN round(numerator / denominator, 9) END AS value FROM ({cells})"


def _theory(w: Work) -> int:
    return w.m.rows[0].count() * w.m.rows[1].count()


def _new_metrics(w: Work) -> DataFrame:
    return _shared(w, "new_metrics", lambda: baseline.snapshot_metrics(w.m.ranked, w.m.kept, w.truth, _theory(w)))


def _old_metrics(w: Work) -> DataFrame:
    return _shared(w, "old_metrics", lambda: baseline.snapshot_metrics(_old(w), decide.retained(_old(w), baseline.BASELINE_RULES), w.truth, _theory(w)))


KEYS = {"source_type": "synthetic", "source_id": "customers", "dataset_fingerprints": "a,b", "candidate_engine": "4", "candidate_config": "default", "evaluation_version": "1"}
add("evl13_snapshot", "truth", f", snap AS ({_nine('ranked', 'kept')}) SELECT * FROM snap", _new_metrics)
add("evl12_baseline_comparison", "truth", f"{_OLD_RANKED}, o AS ({_nine('old_ranked', 'old_kept')}), n AS ({_nine('ranked', 'kept')}) SELECT metric, o.value AS version_a, n.value AS version_b, round(n.value - o.value, 9) AS delta, true AS compatible, '' AS reasons FROM o JOIN n USING (metric)", lambda w: baseline.compared(_old_metrics(w), _new_metrics(w), KEYS, KEYS))
add(
    "evl14_incompatible", "truth", f", n AS ({_nine('ranked', 'kept')}) SELECT metric, value AS version_a, value AS version_b, CAST(NULL AS DOUBLE) AS delta, false AS compatible, 'Different dataset fingerprints. Different candidate configuration.' AS reasons FROM n",
    lambda w: baseline.compared(_new_metrics(w), _new_metrics(w), KEYS, KEYS | {"dataset_fingerprints": "b,a", "candidate_config": "without_names"}),
)

# Revisions: the work's links saved twice, with a writer that comes late


def _revised(w: Work) -> DataFrame:
    folder = shared_folder(w.m.a.sparkSession)
    w.m.folders.append(folder)
    repository = Repository(w.m.a.sparkSession, folder)
    repository.save("run-0", 0, "matched", {"links": w.m.automatic.select("candidate_id", "a_row_id", "b_row_id")})
    repository.save("run-0", 1, "reviewed", {"links": w.links.select("candidate_id", "a_row_id", "b_row_id")})
    try:
        repository.save("run-0", 1, "late", {"links": w.links.where("false")})
        late = "taken"
    except RevisionConflict:
        late = "refused"
    out = [repository.load("run-0", r)[2]["links"].select(F.lit(r).cast("long").alias("revision"), "candidate_id", F.lit(late).alias("late_writer")) for r in repository.revisions("run-0")]
    return out[0].union(out[1])


add("snk07_revisions", "review", "SELECT CAST(1 AS BIGINT) AS revision, candidate_id, 'refused' AS late_writer FROM auto UNION ALL SELECT 2, candidate_id, 'refused' FROM links", _revised)
