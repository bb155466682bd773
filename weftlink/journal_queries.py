"""Queries of the review journal and of integrity of links, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.more_queries import Work, add
from weftlink.operators import decide, journal, survive
from weftlink.plans.entities import MAPPINGS

#: Commands that follow from the kept pairs' ids, in ten runs by the last digit of A's id; two runs end with more undos than are held.
LOG = """
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos, step) AS seq, action, targets, a_row_id, decision, conflict_id FROM (
  SELECT concat('run-', substr(a_row_id, 11, 1)) AS run_id, p.candidate_id AS pos, step, action, CASE WHEN action = 'decide' THEN array(CASE WHEN digit = 'f' THEN 'candidate-unknown' ELSE p.candidate_id END) ELSE array() END AS targets,
    CASE WHEN action IN ('defer', 'restore') THEN a_row_id END AS a_row_id, CASE WHEN action = 'decide' THEN decision END AS decision, CASE WHEN action IN ('resolve', 'replace', 'clear') THEN concat('conflict-', p.candidate_id, '-contact') END AS conflict_id
  FROM (SELECT candidate_id, a_row_id, substr(candidate_id, 11, 1) AS digit FROM {kept}) p JOIN (VALUES {steps}) s(digits, step, action, decision) ON instr(digits, digit) > 0
  UNION ALL SELECT concat('run-', substr(a_row_id, 11, 1)), 'candidate-8', 0, 'decide', array_sort(collect_list(candidate_id)), '', 'same_entity', '' FROM {kept} WHERE substr(candidate_id, 12, 1) = '0' GROUP BY substr(a_row_id, 11, 1)
  UNION ALL SELECT concat('run-', CAST(r AS STRING)), 'x', n, 'undo', array(), '', '', '' FROM (VALUES (3), (4)) v(r) CROSS JOIN (SELECT explode(sequence(1, 25)) AS n) w)
"""
_STEPS = [
    ("0123456", 1, "decide", "same_entity"), ("7", 1, "decide", "same_entity"), ("7", 2, "resolve", ""), ("89", 1, "decide", "different_entity"), ("a", 1, "defer", ""), ("b", 1, "defer", ""), ("b", 2, "restore", ""),
    ("c", 1, "decide", "same_entity"), ("c", 2, "resolve", ""), ("c", 3, "undo", ""), ("c", 4, "replace", ""), ("c", 5, "resolve", ""), ("c", 6, "clear", ""), ("c", 7, "undo", ""), ("d", 1, "undo", ""),
    ("e", 1, "resolve", ""), ("e", 2, "decide", "different_entity"), ("f", 1, "clear", ""), ("f", 2, "decide", "same_entity"), ("f", 3, "defer", ""), ("f", 4, "launch", ""),
]
_VALUES = ", ".join(map(repr, _STEPS))


def log(w: Work) -> DataFrame:
    out = w.m.a.sparkSession.sql(LOG.replace("{steps}", _VALUES), kept=w.m.kept)
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return out.select("run_id", F.col("seq").cast("long").alias("seq"), "action", F.col("targets").cast("array<string>").alias("targets"), *map(empty, ("a_row_id", "decision", "conflict_id")))


def fold(w: Work) -> DataFrame:
    if "journal" not in w.__dict__:
        pairs = w.m.kept.select("candidate_id", "a_row_id", "b_row_id", F.lit("kept").alias("source"))
        differing = survive.conflicts(survive.linked_values(pairs, w.m.a, w.m.b, [m for m in MAPPINGS if m.mapping_id == "contact"]))
        w.__dict__["journal"] = w.m._shared(journal.folded(w.m._shared(log(w)), w.m.kept, w.m.automatic, differing))
    return w.__dict__["journal"]


_LOG_SQL = f"""
steps AS (SELECT * FROM (VALUES {_VALUES}) s(digits, step, action, decision)),
log AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos, step) AS seq, action, targets, a_row_id, decision, conflict_id FROM (
    SELECT 'run-' || substr(a_row_id, 11, 1) AS run_id, candidate_id AS pos, step, action, CASE WHEN action = 'decide' THEN [CASE WHEN substr(candidate_id, 11, 1) = 'f' THEN 'candidate-unknown' ELSE candidate_id END] ELSE [] END AS targets,
      CASE WHEN action IN ('defer', 'restore') THEN a_row_id ELSE '' END AS a_row_id, decision, CASE WHEN action IN ('resolve', 'replace', 'clear') THEN 'conflict-' || candidate_id || '-contact' ELSE '' END AS conflict_id
    FROM kept JOIN steps ON contains(digits, substr(candidate_id, 11, 1))
    UNION ALL SELECT 'run-' || substr(a_row_id, 11, 1), 'candidate-8', 0, 'decide', list_sort(list(candidate_id)), '', 'same_entity', '' FROM kept WHERE substr(candidate_id, 12, 1) = '0' GROUP BY 1
    UNION ALL SELECT 'run-' || r, 'x', n, 'undo', [], '', '', '' FROM (SELECT unnest([3, 4]) AS r) CROSS JOIN (SELECT unnest(range(1, 26)) AS n))),
pair AS (SELECT k.candidate_id AS id, k.a_row_id AS a, k.b_row_id AS b, x.candidate_id IS NOT NULL AS auto, coalesce(sa.contact, '') <> coalesce(sb.contact, '') AS differs
  FROM kept k LEFT JOIN auto x ON x.candidate_id = k.candidate_id JOIN a_src sa ON sa.row_id = k.a_row_id JOIN b_src sb ON sb.row_id = k.b_row_id),
cmds AS MATERIALIZED (
  SELECT l.*, coalesce(t.ts, []) AS ts, len(l.targets) > coalesce(t.n, 0) AS unknown, f.n AS row_n, f.auto AS row_auto, c.id AS c_id, c.a AS c_a, c.b AS c_b, coalesce(c.auto, false) AS c_auto
  FROM log l LEFT JOIN (SELECT run_id, seq, list(struct_pack(id := p.id, a := p.a, b := p.b) ORDER BY p.id) AS ts, count(p.id) AS n FROM (SELECT run_id, seq, unnest(targets) AS id FROM log) u JOIN pair p USING (id) GROUP BY ALL) t USING (run_id, seq)
  LEFT JOIN (SELECT a, count(*) AS n, bool_or(auto) AS auto FROM pair GROUP BY a) f ON f.a = l.a_row_id LEFT JOIN pair c ON c.differs AND 'conflict-' || c.id || '-contact' = l.conflict_id),
runs(run_id, seq, action, outcome, dec, def, res, stack) AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT), '', '', CAST([] AS STRUCT(id VARCHAR, a VARCHAR, b VARCHAR, d VARCHAR)[]), CAST([] AS VARCHAR[]), CAST([] AS STRUCT(k VARCHAR, id VARCHAR)[]), CAST([] AS STRUCT(ids VARCHAR[], back VARCHAR[], d VARCHAR)[]) FROM log
  UNION ALL
  SELECT run_id, seq, action, outcome,
    CASE WHEN NOT ok THEN dec WHEN action = 'decide' THEN list_concat(dec, list_transform(ts, lambda t: struct_pack(id := t.id, a := t.a, b := t.b, d := decision))) WHEN action = 'undo' THEN list_filter(dec, lambda x: NOT list_contains(last.ids, x.id)) ELSE dec END,
    CASE WHEN NOT ok THEN def WHEN action = 'decide' THEN list_filter(def, lambda x: NOT list_contains(list_transform(ts, lambda t: t.a), x)) WHEN action = 'undo' THEN list_distinct(list_concat(def, last.back)) WHEN action = 'defer' THEN list_distinct(list_append(def, a_row_id)) WHEN action = 'restore' THEN list_filter(def, lambda x: x <> a_row_id) ELSE def END,
    CASE WHEN NOT ok THEN res WHEN action IN ('resolve', 'replace') THEN list_distinct(list_append(res, struct_pack(k := conflict_id, id := c_id))) WHEN action = 'clear' THEN list_filter(res, lambda x: x.k <> conflict_id) ELSE res END,
    CASE WHEN NOT ok THEN stack WHEN action = 'decide' THEN list_slice(list_append(stack, struct_pack(ids := list_transform(ts, lambda t: t.id), back := list_distinct(list_filter(list_transform(ts, lambda t: t.a), lambda x: list_contains(def, x))), d := decision)), greatest(len(stack) - 18, 1), len(stack) + 1)
      WHEN action = 'undo' THEN stack[:-2] ELSE stack END
  FROM (SELECT *, outcome = 'accepted' AS ok FROM (SELECT *, CASE action
    WHEN 'decide' THEN CASE WHEN unknown THEN 'candidate_not_found' ELSE coalesce(list_filter(list_transform(ts, lambda t, i: CASE WHEN list_contains(list_transform(dec, lambda x: x.id), t.id) THEN 'decision_exists'
        WHEN decision = 'different_entity' THEN CASE WHEN list_contains(list_transform(res, lambda x: x.id), t.id) THEN 'identity_change_blocked_by_resolutions' END
        WHEN list_contains(list_transform(list_filter(dec, lambda x: x.d = 'same_entity'), lambda x: x.a), t.a) OR list_contains(list_transform(ts[:i - 1], lambda x: x.a), t.a) THEN 'identity_already_confirmed'
        WHEN list_contains(list_transform(list_filter(dec, lambda x: x.d = 'same_entity'), lambda x: x.b), t.b) OR list_contains(list_transform(ts[:i - 1], lambda x: x.b), t.b) THEN 'b_row_already_confirmed' END), lambda x: x IS NOT NULL)[1], 'accepted') END
    WHEN 'undo' THEN CASE WHEN len(stack) = 0 THEN 'nothing_to_undo' WHEN last.d = 'same_entity' AND list_has_any(list_transform(res, lambda x: x.id), last.ids) THEN 'undo_blocked_by_resolutions' ELSE 'accepted' END
    WHEN 'launch' THEN 'unknown_action'
    WHEN 'defer' THEN late WHEN 'restore' THEN late
    ELSE CASE WHEN c_id IS NULL OR NOT (mine = 'same_entity' OR c_auto) THEN 'conflict_not_found' WHEN action = 'clear' THEN CASE WHEN held THEN 'accepted' ELSE 'resolution_missing' END
      WHEN NOT (mine = 'same_entity' OR mine = '' AND c_auto AND NOT list_contains(list_transform(list_filter(dec, lambda x: x.d = 'same_entity'), lambda x: x.a), c_a) AND NOT list_contains(list_transform(list_filter(dec, lambda x: x.d = 'same_entity'), lambda x: x.b), c_b)) THEN 'identity_not_confirmed'
      WHEN held AND action = 'resolve' THEN 'resolution_exists' ELSE 'accepted' END END AS outcome
    FROM (SELECT c.*, r.dec, r.def, r.res, r.stack, r.stack[-1] AS last, coalesce(list_filter(r.dec, lambda x: x.id = c.c_id)[1].d, '') AS mine, list_contains(list_transform(r.res, lambda x: x.k), c.conflict_id) AS held,
        CASE WHEN row_n IS NULL THEN 'review_item_not_found' WHEN list_contains(list_transform(list_filter(r.dec, lambda x: x.d = 'same_entity'), lambda x: x.a), c.a_row_id) OR len(list_filter(r.dec, lambda x: x.a = c.a_row_id)) >= row_n
          OR row_auto AND len(list_filter(r.dec, lambda x: x.a = c.a_row_id)) = 0 AND NOT list_contains(r.def, c.a_row_id) THEN 'review_item_resolved' ELSE 'accepted' END AS late
      FROM runs r JOIN cmds c ON c.run_id = r.run_id AND c.seq = r.seq + 1)))),
ending AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1)
"""
add("rev12_decision_log", "kept", f", {_LOG_SQL} SELECT run_id, seq, action, outcome FROM runs WHERE seq > 0", lambda w: journal.outcomes(fold(w)))
add(
    "rev14_state_after_log", "kept",
    f", {_LOG_SQL} SELECT run_id, 'decision' AS kind, x.id AS key, x.d AS value FROM (SELECT run_id, unnest(dec) AS x FROM ending) UNION ALL SELECT run_id, 'deferral', unnest(def), 'deferred' FROM ending UNION ALL SELECT run_id, 'resolution', x.k, x.id FROM (SELECT run_id, unnest(res) AS x FROM ending)",
    lambda w: journal.state(fold(w)),
)
add(
    "asg04_integrity", "kept",
    """, same AS (SELECT candidate_id, a_row_id, b_row_id FROM kept WHERE substr(candidate_id, 11, 1) IN ('0', '1', '2', '3', '4')), claims AS (SELECT 'A' AS side, a_row_id AS row_id, candidate_id FROM same UNION ALL SELECT 'B', b_row_id, candidate_id FROM same)
    SELECT side, row_id, count(*) AS n, string_agg(candidate_id, ',' ORDER BY candidate_id) AS candidates, 'one_to_one_integrity_violation' AS code FROM claims GROUP BY ALL HAVING count(*) > 1""",
    lambda w: decide.violations(w.m.kept, w.m.kept.where("substr(candidate_id, 11, 1) IN ('0', '1', '2', '3', '4')").select("candidate_id", F.lit("same_entity").alias("decision"))),
)
