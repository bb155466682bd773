"""Queries of the retrospective analyses and of review studies, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.more_queries import _BY, _KNOWN, Work, _related, add
from weftlink.operators import analysis as A
from weftlink.operators import decide, study
from weftlink.plans.model import BLOCKERS
from weftlink.queries import query


def _shared(w: Work, name: str, make) -> DataFrame:
    if name not in w.__dict__:
        w.__dict__[name] = w.m._shared(make())
    return w.__dict__[name]


def _truths(w: Work) -> tuple[DataFrame, DataFrame]:
    return tuple(x.select("row_id", "entity_id") for x in (w.m.a, w.m.b))


# Strata and suppression

add(
    "evl17_strata", "truth",
    """, sharing AS (SELECT DISTINCT t.a_row_id, t.b_row_id FROM truth t JOIN ka ON ka.row_id = t.a_row_id JOIN kb ON kb.row_id = t.b_row_id AND kb.blocker_id = ka.blocker_id AND kb.key = ka.key WHERE ka.blocker_id = 'exact_strong_v1'),
    marked AS (SELECT CASE WHEN s.a_row_id IS NULL THEN 'weak_identifier' ELSE 'strong_identifier' END AS stratum, p.a_row_id AS hit FROM truth t LEFT JOIN sharing s USING (a_row_id, b_row_id) LEFT JOIN pairs p ON p.a_row_id = t.a_row_id AND p.b_row_id = t.b_row_id)
    SELECT *, true_pairs - retained AS missed, CASE WHEN true_pairs > 0 THEN round(retained / true_pairs, 9) END AS recall FROM (SELECT e.stratum, count(m.stratum) AS true_pairs, count(hit) AS retained
      FROM (SELECT unnest(['strong_identifier', 'weak_identifier', 'all']) AS stratum) e LEFT JOIN marked m ON e.stratum IN (m.stratum, 'all') GROUP BY e.stratum)""",
    lambda w: A.strata(w.truth, w.m.pairs, *w.m.keys),
)
add(
    "evl18_suppression", "truth",
    f"""{_BY}, held AS (SELECT DISTINCT t.a_row_id, t.b_row_id, ka.blocker_id FROM truth t JOIN ka ON ka.row_id = t.a_row_id JOIN kb ON kb.row_id = t.b_row_id AND kb.blocker_id = ka.blocker_id AND kb.key = ka.key JOIN buckets u ON u.blocker_id = ka.blocker_id AND u.key = ka.key WHERE u.suppressed),
    fate AS (SELECT h.a_row_id, h.b_row_id, list(DISTINCT h.blocker_id) AS held, (SELECT count(*) FROM byb WHERE byb.a_row_id = h.a_row_id AND byb.b_row_id = h.b_row_id) AS found,
      (SELECT count(*) FROM byb WHERE byb.a_row_id = h.a_row_id AND byb.b_row_id = h.b_row_id AND byb.blocker_id NOT IN (SELECT x.blocker_id FROM held x WHERE x.a_row_id = h.a_row_id AND x.b_row_id = h.b_row_id)) AS other FROM held h GROUP BY h.a_row_id, h.b_row_id),
    e AS (SELECT unnest({[*BLOCKERS, 'all']}) AS blocker_id)
    SELECT e.blocker_id, count(f.a_row_id) AS affected, count(*) FILTER (found > 0) AS rescued, count(*) FILTER (other > 0) AS rescued_by_other, count(*) FILTER (found = 0) AS missed,
      (SELECT count(*) FROM buckets u WHERE u.suppressed AND e.blocker_id IN (u.blocker_id, 'all')) AS keys_suppressed, CAST(coalesce((SELECT sum(n_a * n_b) FROM buckets u WHERE u.suppressed AND e.blocker_id IN (u.blocker_id, 'all')), 0) AS BIGINT) AS relationships_suppressed
    FROM e LEFT JOIN fate f ON list_contains(f.held, e.blocker_id) OR e.blocker_id = 'all' GROUP BY e.blocker_id""",
    lambda w: A.suppression(w.truth, w.m.pairs, *w.m.keys, w.m.buckets),
)

# Hard negatives: entities of neighbouring keys with one reference, decoys of an entity, and those that differ in one word only

PATTERNS = """
SELECT 1 AS place, k AS left_entity, k + 1 AS right_entity, 'shared_reference' AS pattern FROM ents WHERE k % 41 = 0 AND k % 3 = 0
UNION ALL SELECT 2, k, -k, 'decoy' FROM ents WHERE k % 59 = 0 UNION ALL SELECT 3, k + 130, k, 'one_word_apart' FROM ents WHERE k % 20 = 0 UNION ALL SELECT 4, k, k + 1, 'neighbour' FROM ents WHERE k % 123 = 0
"""
_HARD = f""", ents AS (SELECT DISTINCT entity_id AS k FROM a_src), patterns AS ({PATTERNS}),
hard AS (SELECT a_row_id, b_row_id, arg_max(pattern, place) AS pattern FROM (
  SELECT a.row_id AS a_row_id, b.row_id AS b_row_id, pattern, place * 2 AS place FROM patterns JOIN a_src a ON a.entity_id = left_entity JOIN b_src b ON b.entity_id = right_entity
  UNION ALL SELECT a.row_id, b.row_id, pattern, place * 2 + 1 FROM patterns JOIN a_src a ON a.entity_id = right_entity JOIN b_src b ON b.entity_id = left_entity) GROUP BY a_row_id, b_row_id)"""


def hard(w: Work) -> DataFrame:
    def make() -> DataFrame:
        ents = w.m.a.select(F.col("entity_id").alias("k")).distinct()
        return A.hard_negatives(*_truths(w), w.m.a.sparkSession.sql(PATTERNS.replace("FROM ents", "FROM {ents}"), ents=ents))

    return _shared(w, "hard", make)


add(
    "evl06_hard_negatives", "truth",
    f"""{_HARD} SELECT h.a_row_id, h.b_row_id, h.pattern, r.a_row_id IS NOT NULL AS generated, score, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_top, rank = 1 AND band = 'auto_match' AS auto_matched
    FROM hard h LEFT JOIN ranked r ON r.a_row_id = h.a_row_id AND r.b_row_id = h.b_row_id""",
    lambda w: A.hard_outcomes(hard(w), w.m.ranked),
)
_COVERED = ", ".join(f"count(*) FILTER (EXISTS (SELECT 1 FROM byb WHERE byb.a_row_id = h.a_row_id AND byb.b_row_id = h.b_row_id AND byb.blocker_id = '{b}')) AS {b}" for b in BLOCKERS)
add(
    "evl19_hard_negative_coverage", "truth",
    f"""{_BY} {_HARD} SELECT *, round(entered / known, 9) AS coverage FROM (SELECT h.name AS pattern, count(*) AS known, count(*) FILTER (EXISTS (SELECT 1 FROM pairs p WHERE p.a_row_id = h.a_row_id AND p.b_row_id = h.b_row_id)) AS entered, {_COVERED}
    FROM (SELECT a_row_id, b_row_id, unnest([pattern, 'all']) AS name FROM hard) h GROUP BY h.name)""",
    lambda w: A.hard_coverage(hard(w), w.m.pairs),
)

# Stages

add(
    "evl25_stage_metrics", "truth",
    """, c AS (SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(DISTINCT a_row_id) FROM truth) AS matchable_a, (SELECT count(*) FROM truth) AS truth_pairs, (SELECT count(DISTINCT a_row_id) FROM kept) AS bearing_a,
      (SELECT count(*) FROM pairs) AS generated, (SELECT count(*) FROM pairs JOIN truth USING (a_row_id, b_row_id)) AS generated_true, (SELECT count(*) FROM kept) AS retained, (SELECT count(*) FROM kept JOIN truth USING (a_row_id, b_row_id)) AS retained_true,
      (SELECT count(*) FROM kept WHERE rank = 1) AS top, (SELECT count(*) FROM kept JOIN truth USING (a_row_id, b_row_id) WHERE rank = 1) AS top_true, (SELECT count(*) FROM auto) AS assigned, (SELECT count(*) FROM auto JOIN truth USING (a_row_id, b_row_id)) AS assigned_true,
      (SELECT count(DISTINCT a_row_id) FROM kept WHERE a_row_id NOT IN (SELECT a_row_id FROM auto)) AS review_a, (SELECT count(DISTINCT a_row_id) FROM kept JOIN truth USING (a_row_id, b_row_id) WHERE a_row_id NOT IN (SELECT a_row_id FROM auto)) AS kept_true_review,
      (SELECT count(DISTINCT k.a_row_id) FROM kept k WHERE k.a_row_id NOT IN (SELECT a_row_id FROM auto) AND k.a_row_id IN (SELECT a_row_id FROM truth)) AS review_matchable_a, (SELECT count(DISTINCT b_row_id) FROM auto) AS assigned_b)
    SELECT rows_a, rows_b, matchable_a, truth_pairs, bearing_a, generated, generated_true, retained, retained_true, top, top_true, assigned, assigned_true, truth_pairs - generated_true AS lost_in_generation, generated_true - retained_true AS lost_in_retention, retained_true - assigned_true AS left_to_review,
      CAST(0 AS BIGINT) AS unexplained, round(generated_true / truth_pairs, 9) AS candidate_recall, round(1 - generated / (rows_a * rows_b), 9) AS candidate_reduction, round(retained_true / truth_pairs, 9) AS retained_recall, round(1 - retained / (rows_a * rows_b), 9) AS retained_reduction,
      round(top_true / top, 9) AS top_precision, assigned - assigned_true AS assigned_false, round(assigned_true / assigned, 9) AS auto_precision, round(assigned_true / truth_pairs, 9) AS auto_recall, round(assigned_true / matchable_a, 9) AS auto_row_recall, review_a, round(review_a / rows_a, 9) AS review_rate,
      round(review_matchable_a / matchable_a, 9) AS review_rate_matchable, rows_a - bearing_a AS without_retained_a, assigned - assigned_b AS double_b_claims FROM c""",
    lambda w: A.stage_metrics(w.m.rows[0], w.m.rows[1], w.truth, w.m.pairs, w.m.kept, w.m.automatic),
)

# Errors

_ERRORS = f"""{_HARD}, known AS (SELECT t.a_row_id, t.b_row_id, r.score, r.rank, r.candidate_id IS NOT NULL AS generated, k.candidate_id IS NOT NULL AS kept FROM truth t LEFT JOIN ranked r ON r.a_row_id = t.a_row_id AND r.b_row_id = t.b_row_id LEFT JOIN kept k ON k.candidate_id = r.candidate_id),
lost AS (SELECT a_row_id, bool_or(kept) AS covered, coalesce(min(b_row_id) FILTER (generated), min(b_row_id)) AS b_row_id, bool_or(generated) AS generated FROM known GROUP BY a_row_id),
errors AS (
  SELECT 'candidate_misses' AS "group", 'candidate_no_shared_key' AS kind, a_row_id, b_row_id, 'candidate_generation' AS stage, 'True link did not reach feature scoring.' AS reason, score, CAST(rank AS INTEGER) AS rank FROM known WHERE NOT generated
  UNION ALL SELECT 'ranking_losses', 'ranking_wrong_top1', a_row_id, b_row_id, 'ranking', 'A false candidate ranked above the best true candidate.', score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a_row_id ORDER BY rank) AS n FROM known WHERE generated) WHERE n = 1 AND rank > 1
  UNION ALL SELECT 'post_score_losses', CASE WHEN rank > 3 THEN 'retention_top_n' ELSE 'retention_threshold' END, a_row_id, b_row_id, 'post_score_retention', CASE WHEN rank > 3 THEN 'top_n_alternative_limit' ELSE 'review_cutoff' END, score, rank FROM known WHERE generated AND NOT kept
  UNION ALL SELECT 'hard_negatives', 'hard_negative_case', a_row_id, b_row_id, 'adversarial_check', pattern, score, rank FROM hard JOIN ranked USING (a_row_id, b_row_id)
  UNION ALL SELECT 'false_auto_matches', 'auto_match_false_positive', a_row_id, b_row_id, 'decision_policy', 'Automatically linked pair is false in fixture truth.', score, rank FROM ranked r WHERE rank = 1 AND band = 'auto_match' AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.a_row_id = r.a_row_id AND t.b_row_id = r.b_row_id)
  UNION ALL SELECT 'false_unmatched', CASE WHEN l.generated THEN 'unmatched_decision_policy' ELSE 'unmatched_candidate_miss' END, l.a_row_id, l.b_row_id, CASE WHEN l.generated THEN 'decision_coverage' ELSE 'candidate_generation' END, 'Matchable A row has no true pair retained for decision coverage.', k.score, NULL FROM lost l JOIN known k USING (a_row_id, b_row_id) WHERE NOT covered)"""


def errors(w: Work) -> DataFrame:
    return _shared(w, "errors", lambda: A.errors(w.truth, w.m.ranked, w.m.kept, hard(w)))


add("evl16_errors", "truth", f"{_ERRORS} SELECT * FROM errors", errors)
add("evl16_error_counts", "truth", f'{_ERRORS} SELECT e."group", count(x.a_row_id) AS errors, count(DISTINCT x.a_row_id) AS a_rows FROM (SELECT unnest({list(A.ERROR_GROUPS)}) AS "group") e LEFT JOIN errors x ON x."group" = e."group" GROUP BY e."group"', lambda w: A.error_counts(errors(w)))
_NUMBERED = 'SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY a_row_id, b_row_id) AS INTEGER) AS number FROM errors'
add("evl16_error_examples", "truth", f"{_ERRORS} SELECT * FROM ({_NUMBERED}) WHERE number <= 10", lambda w: A.error_page(errors(w)))
add("flt04_error_group", "truth", f"{_ERRORS} SELECT * FROM ({_NUMBERED}) WHERE \"group\" = 'post_score_losses' AND number <= 25", lambda w: A.error_page(errors(w), "post_score_losses", 25))

# Review demand

_DEMAND = """, na AS (SELECT entity_id, count(*) AS n FROM a_src GROUP BY entity_id), nb AS (SELECT entity_id, count(*) AS n FROM b_src GROUP BY entity_id),
shares AS (SELECT b_row_id, count(DISTINCT a_row_id) AS owners FROM kept GROUP BY b_row_id), tops AS (SELECT k.*, s.owners FROM kept k JOIN shares s USING (b_row_id) WHERE rank = 1),
demand AS (
  SELECT *, bearing AND NOT automatic AS reviewed, CASE WHEN bearing AND NOT automatic THEN CASE WHEN top_band = 'needs_review' THEN 'matcher_needs_review' WHEN top_collision THEN 'matcher_collision_hint' WHEN owners > 1 THEN 'shared_b_candidate' ELSE 'other_assignment_guard' END END AS cause,
    CASE WHEN bearing AND NOT automatic THEN CASE WHEN truth_class = 'no_cross_source_identity' THEN truth_class WHEN top_true THEN 'top_rank_true' WHEN kept_true THEN 'retained_true_alternative' WHEN generated_true THEN 'generated_true_not_retained' ELSE 'true_not_generated' END END AS evidence
  FROM (SELECT s.row_id AS a_row_id, t.candidate_id IS NOT NULL AS bearing, x.candidate_id IS NOT NULL AS automatic, t.band AS top_band, t.collision AS top_collision, t.owners, t.score, t.margin, t.contradiction,
      CASE WHEN nb.n IS NULL THEN 'no_cross_source_identity' WHEN nb.n > 1 OR na.n > 1 THEN 'duplicated_cross_source_identity' ELSE 'unique_cross_source_identity' END AS truth_class,
      EXISTS (SELECT 1 FROM truth u WHERE u.a_row_id = s.row_id AND u.b_row_id = t.b_row_id) AS top_true, s.row_id IN (SELECT k.a_row_id FROM kept k JOIN truth u ON u.a_row_id = k.a_row_id AND u.b_row_id = k.b_row_id) AS kept_true,
      s.row_id IN (SELECT p.a_row_id FROM pairs p JOIN truth u ON u.a_row_id = p.a_row_id AND u.b_row_id = p.b_row_id) AS generated_true
    FROM a_src s JOIN na ON na.entity_id = s.entity_id LEFT JOIN nb ON nb.entity_id = s.entity_id LEFT JOIN tops t ON t.a_row_id = s.row_id LEFT JOIN auto x ON x.a_row_id = s.row_id)),
gates AS (SELECT unnest(CASE WHEN len(g) = 0 THEN ['no_observable_blocker'] ELSE g END) AS gate FROM (SELECT list_filter([CASE WHEN score < 0.5 THEN 'below_auto_score_threshold' END, CASE WHEN margin < 0.04 THEN 'below_minimum_top_margin' END, CASE WHEN contradiction THEN 'strong_contradiction' END, CASE WHEN top_collision THEN 'matcher_collision_flag' END], lambda x: x IS NOT NULL) AS g FROM demand WHERE cause = 'matcher_needs_review'))"""
_CLASS, _EVID = "truth_class", "evidence"
_each = lambda name, words: f"(SELECT unnest({list(words)}) AS {name})"
add(
    "evl26_demand", "truth",
    f"""{_DEMAND} SELECT 'denominator' AS section, 'source_a_rows' AS key, '' AS other, count(*) AS n FROM demand UNION ALL SELECT 'denominator', 'candidate_bearing_a_rows', '', count(*) FROM demand WHERE bearing UNION ALL SELECT 'denominator', 'automatic_a_rows', '', count(*) FROM demand WHERE automatic
    UNION ALL SELECT 'denominator', 'review_routed_a_rows', '', count(*) FROM demand WHERE reviewed UNION ALL SELECT 'denominator', 'matchable_a_rows', '', count(*) FROM demand WHERE truth_class <> 'no_cross_source_identity' UNION ALL SELECT 'denominator', 'no_retained_candidate_a_rows', '', count(*) FROM demand WHERE NOT bearing
    UNION ALL SELECT 'cause', c, '', count(a_row_id) FROM {_each('c', A.CAUSES)} LEFT JOIN demand ON cause = c GROUP BY c
    UNION ALL SELECT 'truth_class', t, '', count(a_row_id) FROM {_each('t', A.TRUTH_CLASSES)} LEFT JOIN demand ON reviewed AND truth_class = t GROUP BY t
    UNION ALL SELECT 'truth_evidence', e, '', count(a_row_id) FROM {_each('e', A.EVIDENCE)} LEFT JOIN demand ON evidence = e GROUP BY e
    UNION ALL SELECT 'gate', g, '', count(gate) FROM {_each('g', A.GATES)} LEFT JOIN gates ON gate = g GROUP BY g
    UNION ALL SELECT 'cause_by_truth_class', c, t, count(a_row_id) FROM {_each('c', A.CAUSES)} CROSS JOIN {_each('t', A.TRUTH_CLASSES)} LEFT JOIN demand ON cause = c AND truth_class = t GROUP BY c, t
    UNION ALL SELECT 'cause_by_truth_evidence', c, e, count(a_row_id) FROM {_each('c', A.CAUSES)} CROSS JOIN {_each('e', A.EVIDENCE)} LEFT JOIN demand ON cause = c AND evidence = e GROUP BY c, e
    UNION ALL SELECT 'no_candidate_by_truth_class', t, '', count(a_row_id) FROM {_each('t', A.TRUTH_CLASSES)} LEFT JOIN demand ON NOT bearing AND truth_class = t GROUP BY t""",
    lambda w: A.reconciled(_shared(w, "demand_counts", lambda: A.demand(_demand(w)))),
)
add("evl26_examples", "truth", f"{_DEMAND} SELECT cause, place, a_row_id FROM (SELECT cause, a_row_id, CAST(row_number() OVER (PARTITION BY cause ORDER BY a_row_id) AS INTEGER) AS place FROM demand WHERE reviewed) WHERE place <= 5", lambda w: A.demand_examples(_demand(w)))


def _demand(w: Work) -> DataFrame:
    return _shared(w, "demand_rows", lambda: A.demand_rows(*_truths(w), w.m.pairs, w.m.kept, w.m.automatic))


# Review workload


def _cases(w: Work) -> DataFrame:
    return _shared(w, "cases", lambda: A.cases(w.m.ranked, w.m.kept.join(w.m.pairs.select("candidate_id", "blocking_evidence"), "candidate_id"), w.m.fields, w.truth))


def _edges(c: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {c} < {high!r} THEN '{low:.2f}-{high:.2f}'" for low, high in zip(edges, edges[1:], strict=False)) + " END"


_WEAK = "f.kind IN ('contact_person', 'geography', 'categorical', 'source_local_identifier', 'free_text', 'unknown') OR f.information IN ('repeated', 'common')"
_CASES = f"""{_KNOWN}, facts AS (SELECT candidate_id, string_agg(kind || ':' || class || ':' || information, '|' ORDER BY place) AS ev, list(mapping_id ORDER BY mapping_id) FILTER (plus > 0) AS positive, count(*) FILTER (kind = 'persistent_identifier' AND class = 'exact_agreement') AS eq, count(*) FILTER (kind = 'persistent_identifier' AND class = 'conflict') AS ne,
  count(*) FILTER (plus > 0) AS pos, count(*) FILTER (plus > 0 AND ({_WEAK})) AS weak, count(*) FILTER (kind IN ('persistent_identifier', 'name_or_title', 'email', 'phone', 'address') AND class IN ('exact_agreement', 'partial_agreement') AND plus > 0 AND information <> 'common') AS strong FROM fields f GROUP BY candidate_id),
cases AS (SELECT *, NOT collision AND margin >= 0.04 AND NOT contradiction AND ne = 0 AND strong >= 2 AS same_eligible, NOT collision AND margin >= 0.04 AND candidates = 1 AND eq = 0 AND strong < 2 AND pos > 0 AND weak = pos AS different_eligible,
  ev || '|margin:' || {_edges("margin", A.MARGIN_EDGES)} || '|alternatives:' || CASE WHEN candidates > 1 THEN 'multiple' ELSE 'single' END || '|collision:' || collision || '|strong:' || contradiction AS signature
  FROM (SELECT k.*, f.* EXCLUDE (candidate_id), count(*) OVER (PARTITION BY k.a_row_id) AS candidates, bool_or(n.yes) OVER (PARTITION BY k.a_row_id) AS kept_true, n.yes AS top_true, (SELECT min(x.rank) FROM known x WHERE x.a_row_id = k.a_row_id AND x.yes) AS true_rank
    FROM kept k JOIN known n USING (candidate_id) JOIN facts f USING (candidate_id)) WHERE rank = 1 AND band <> 'auto_match'),
wgroups AS (SELECT signature, count(*) AS cases, count(*) FILTER (same_eligible) AS same_eligible, count(*) FILTER (different_eligible) AS different_eligible, CASE count(*) WHEN count(*) FILTER (same_eligible) THEN 'same_entity' WHEN count(*) FILTER (different_eligible) THEN 'different_entity' END AS suggested FROM cases GROUP BY signature)"""
add("evl22_groups", "truth", f"{_CASES} SELECT * FROM wgroups", lambda w: A.workload_groups(_cases(w)))
add(
    "evl22_distributions", "truth",
    f"""{_BY} {_CASES} SELECT distribution, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM cases), 9) AS rate FROM (
      SELECT 'score_band' AS distribution, {_edges("score", A.SCORE_EDGES)} AS value FROM cases UNION ALL SELECT 'margin_band', {_edges("margin", A.MARGIN_EDGES)} FROM cases UNION ALL SELECT 'signature', signature FROM cases
      UNION ALL SELECT 'blocker', r.blocker_id FROM cases JOIN (SELECT DISTINCT a_row_id, b_row_id, blocker_id, key_hash FROM related) r USING (a_row_id, b_row_id) UNION ALL SELECT 'positive_field', unnest(positive) FROM cases) GROUP BY ALL""",
    lambda w: A.workload_distributions(_cases(w)),
)
_METRICS = {
    "theoretical_pairs": "(SELECT count(*) FROM a) * (SELECT count(*) FROM b)", "candidate_pairs": "(SELECT count(*) FROM pairs)", "candidate_reduction": "round(1 - (SELECT count(*) FROM pairs) / ((SELECT count(*) FROM a) * (SELECT count(*) FROM b)), 9)",
    "candidate_recall": "round((SELECT count(*) FROM pairs JOIN truth USING (a_row_id, b_row_id)) / (SELECT count(*) FROM truth), 9)", "auto_matches": "(SELECT count(*) FROM known WHERE rank = 1 AND band = 'auto_match')",
    "auto_precision": "(SELECT round(count(*) FILTER (yes) / count(*), 9) FROM known WHERE rank = 1 AND band = 'auto_match')", "false_auto_matches": "(SELECT count(*) FROM known WHERE rank = 1 AND band = 'auto_match' AND NOT yes)", "review_count": "(SELECT count(*) FROM cases)",
    "review_yield": "(SELECT round(count(true_rank) / count(*), 9) FROM cases)", "review_true_top": "(SELECT count(*) FROM cases WHERE top_true)", "review_false_top": "(SELECT count(*) FROM cases WHERE NOT top_true)", "review_truth_in_alternatives": "(SELECT count(*) FROM cases WHERE kept_true AND NOT top_true)",
    "review_no_true_candidate": "(SELECT count(*) FROM cases WHERE true_rank IS NULL)", "collisions": "(SELECT count(*) FROM cases WHERE collision)", "near_ties": "(SELECT count(*) FROM cases WHERE margin < 0.04)", "batch_same_eligible": "(SELECT count(*) FROM cases WHERE same_eligible)",
    "batch_different_eligible": "(SELECT count(*) FROM cases WHERE different_eligible)", **{f"score_p{p}": f"(SELECT quantile_cont(score, {p / 100}) FROM cases)" for p in (10, 50, 90)}, "review_groups": "(SELECT count(*) FROM wgroups)",
    "individual_reviews": "(SELECT coalesce(sum(cases), 0) FROM wgroups WHERE suggested IS NULL)", **{f"group_size_p{p}": f"(SELECT quantile_cont(CAST(cases AS DOUBLE), {p / 100}) FROM wgroups)" for p in (50, 90)},
    "only_a": "(SELECT count(*) FROM a WHERE row_id NOT IN (SELECT a_row_id FROM kept))", "only_b": "(SELECT count(*) FROM b WHERE row_id NOT IN (SELECT b_row_id FROM kept WHERE band = 'auto_match' AND rank = 1))", "no_match_found_in_b": "(SELECT count(*) FROM a WHERE row_id NOT IN (SELECT a_row_id FROM kept))",
    "no_match_found_in_a": "(SELECT count(*) FROM b WHERE row_id NOT IN (SELECT b_row_id FROM kept WHERE band = 'auto_match' AND rank = 1) AND row_id NOT IN (SELECT b_row_id FROM kept WHERE a_row_id IN (SELECT a_row_id FROM cases)))",
}


def _metrics(w: Work) -> DataFrame:
    stages = A.stage_metrics(w.m.rows[0], w.m.rows[1], w.truth, w.m.pairs, w.m.kept, w.m.automatic)
    found = _cases(w)
    return A.workload_metrics(found, A.workload_groups(found), stages, w.m.ranked, w.m.kept, w.truth, decide.only_a(w.m.rows[0], w.m.kept), decide.only_b(w.m.rows[1], w.m.kept))


add("evl22_metrics", "truth", f"{_CASES} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value" for k, v in _METRICS.items()), _metrics)

# Review studies: the users' events as sessions, some of which break the log's rules

STUDY = """
SELECT concat('session-', CAST(user_id AS STRING)) AS session_id, concat('reviewer-', CAST(user_id % 40 AS STRING)) AS reviewer_id, 'tasks-1' AS task_set_id, CASE WHEN user_id % 2 = 0 THEN 'standard_queue' ELSE 'collision_inspector' END AS arm, i AS place,
  CASE WHEN user_id % 10 = 7 AND i = 9 THEN CAST(0 AS BIGINT) ELSE ms END AS at_ms, CASE WHEN user_id % 10 = 6 AND i = 5 THEN 'case-unknown' ELSE concat('case-', CAST((floor(i / 4) * 7 + user_id) % 500 AS INT)) END AS case_id,
  CASE i % 4 WHEN 0 THEN 'open_case' WHEN 1 THEN 'inspect_candidate' WHEN 2 THEN CASE WHEN user_id % 2 = 1 OR user_id % 10 = 8 THEN 'open_collision' ELSE 'inspect_candidate' END ELSE CASE WHEN event_type = 'error' THEN 'skip_case' ELSE 'record_decision' END END AS action,
  CASE WHEN i % 4 = 3 AND event_type <> 'error' THEN CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'same_entity' ELSE 'different_entity' END END AS decision
FROM (SELECT user_id, event_type, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, {ms} AS ms FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) t
WHERE i < floor(n / 4) * 4 OR user_id % 10 = 9
"""
LABELS = "SELECT concat('case-', CAST({i} AS STRING)) AS case_id, CASE WHEN {i} % 3 = 0 THEN 'same_entity' ELSE 'different_entity' END AS expected FROM {source}"


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    ms = "unix_millis(CAST(ts AS TIMESTAMP)) - min(unix_millis(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id)"
    labels = spark.sql(LABELS.replace("{i}", "id").replace("{source}", "{ids}"), ids=spark.range(500))
    return spark.sql(STUDY.replace("{ms}", ms), events=events), labels


_STUDY_SQL = f"""WITH log AS MATERIALIZED ({STUDY.replace('{events}', 'events').replace('{ms}', "epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id)")}), labels AS ({LABELS.replace('{i}', 'i').replace('{source}', '(SELECT unnest(range(500)) AS i)')}),
told AS (SELECT l.*, t.expected, lag(at_ms) OVER w AS before_ms, count(*) FILTER (action = 'open_case') OVER p AS opened, count(*) FILTER (action IN ('record_decision', 'skip_case')) OVER p AS closed, last_value(CASE WHEN action = 'open_case' THEN l.case_id END IGNORE NULLS) OVER p AS at_case,
  row_number() OVER (PARTITION BY session_id, l.case_id, action ORDER BY place) AS again, lead(place) OVER w AS nxt FROM log l LEFT JOIN labels t ON t.case_id = l.case_id WINDOW w AS (PARTITION BY session_id ORDER BY place), p AS (PARTITION BY session_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, CASE WHEN expected IS NULL THEN 'unlabeled_case' WHEN at_ms < 0 OR at_ms < before_ms THEN 'time_not_monotonic' WHEN action = 'open_case' THEN CASE WHEN coalesce(opened, 0) > coalesce(closed, 0) THEN 'case_still_open' WHEN again > 1 THEN 'case_revisited' END
  WHEN coalesce(opened, 0) <= coalesce(closed, 0) OR at_case <> case_id THEN 'case_not_open' WHEN action = 'open_collision' AND arm <> 'collision_inspector' THEN 'collision_in_standard_arm' END AS broken FROM told),
bad AS (SELECT session_id, coalesce(arg_min(broken, place) FILTER (broken IS NOT NULL), 'case_unclosed') AS code, coalesce(min(place) FILTER (broken IS NOT NULL), max(place)) AS place FROM judged GROUP BY session_id HAVING count(broken) > 0 OR bool_or(nxt IS NULL AND action NOT IN ('record_decision', 'skip_case')))"""
query("evl27_violations", f"{_STUDY_SQL} SELECT session_id, CAST(place AS BIGINT) AS place, code FROM bad")(lambda spark, sf_dir: study.violations(*_log(spark, sf_dir)))


@query(
    "evl27_study",
    f"""{_STUDY_SQL}, good AS (SELECT * FROM judged WHERE session_id NOT IN (SELECT session_id FROM bad)),
    seen AS (SELECT arm, session_id, case_id, any_value(reviewer_id) AS reviewer_id, any_value(expected) AS expected, max(decision) AS decision, max(at_ms) - min(at_ms) AS ms, count(*) FILTER (action IN ('inspect_candidate', 'open_collision')) AS nav FROM good GROUP BY ALL),
    same_cases AS (SELECT (SELECT count(*) FROM seen WHERE arm = 'standard_queue') > 0 AND (SELECT count(*) FROM seen WHERE arm <> 'standard_queue') > 0 AND count(*) FILTER (n < 2) = 0 AS ok FROM (SELECT case_id, count(DISTINCT arm) AS n FROM seen GROUP BY case_id))
    SELECT e.arm, count(DISTINCT session_id) AS sessions, count(DISTINCT reviewer_id) AS reviewers, count(DISTINCT case_id) AS unique_cases, count(case_id) AS cases, count(decision) AS decisions, count(case_id) - count(decision) AS skipped, count(*) FILTER (decision = expected) AS correct,
      count(*) FILTER (decision = 'same_entity' AND expected = 'different_entity') AS false_positive, count(*) FILTER (decision = 'different_entity' AND expected = 'same_entity') AS false_negative, round(count(*) FILTER (decision = expected) / nullif(count(decision), 0), 9) AS accuracy,
      median(CAST(ms AS DOUBLE)) FILTER (decision IS NOT NULL) AS median_ms, CAST(coalesce(sum(nav) FILTER (decision IS NOT NULL), 0) AS BIGINT) AS navigation, round(sum(nav) FILTER (decision IS NOT NULL) / nullif(count(decision), 0), 9) AS navigation_per_decision, (SELECT ok FROM same_cases) AS same_cases
    FROM (SELECT unnest(['standard_queue', 'collision_inspector']) AS arm) e LEFT JOIN seen s ON s.arm = e.arm GROUP BY e.arm""",
)
def evl27_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, labels = _log(spark, sf_dir)
    return study.arms(study.valid(log, labels), labels)
