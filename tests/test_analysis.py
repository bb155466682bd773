"""Retrospective analyses and review studies on small tables whose answers are plain."""

import pytest

from weftlink.operators import analysis as A
from weftlink.operators import baseline, evaluate, review, study
from weftlink.plans.model import Invalid
from weftlink.sources import layouts

PAIR = "a_row_id string, b_row_id string"
KEPT = f"candidate_id string, {PAIR}, rank int, score double, margin double, band string, collision boolean, contradiction boolean"


def kept(spark, *rows):
    return spark.createDataFrame([(f"{a}-{b}", a, b, rank, 0.9, 0.5, band, False, False) for a, b, band, rank in rows], KEPT)


def truths(spark, a, b):
    return tuple(spark.createDataFrame(x, "row_id string, entity_id string") for x in (a, b))


def counts(rows):
    return {(r.section, r.key, r.other): r.n for r in A.reconciled(A.demand(rows)).collect()}


AUTO, REVIEW = "auto_match", "needs_review"
A3, B3 = [("A1", "e1"), ("A2", "e2"), ("A3", "e3")], [("B1", "e1"), ("B2", "e2"), ("B3", "e4")]


def test_demand_tells_abstention_from_a_shared_row(spark):
    k = kept(spark, ("A1", "B1", AUTO, 1), ("A2", "B1", AUTO, 1), ("A3", "B3", REVIEW, 1))
    n = counts(A.demand_rows(*truths(spark, A3, B3), k, k, k.where("false")))
    assert [n["denominator", x, ""] for x in ("source_a_rows", "candidate_bearing_a_rows", "automatic_a_rows", "review_routed_a_rows", "no_retained_candidate_a_rows")] == [3, 3, 0, 3, 0]
    assert n["cause", "shared_b_candidate", ""] == 2 and n["cause", "matcher_needs_review", ""] == 1
    assert n["truth_evidence", "top_rank_true", ""] == 1 and n["truth_evidence", "no_cross_source_identity", ""] == 1
    assert n["cause_by_truth_evidence", "shared_b_candidate", "top_rank_true"] == 1
    assert n["gate", "no_observable_blocker", ""] == 1 and len(n) == 6 + 6 + 3 + 5 + 5 + 18 + 30 + 3


def test_demand_knows_duplicates(spark):
    k = kept(spark, ("A1", "B1", AUTO, 1), ("A2", "B1", AUTO, 1))
    n = counts(A.demand_rows(*truths(spark, [("A1", "e1"), ("A2", "e1"), ("A3", "alone")], [("B1", "e1")]), k, k, k.where("false")))
    assert n["denominator", "matchable_a_rows", ""] == 2 and n["truth_class", "duplicated_cross_source_identity", ""] == 2
    assert n["no_candidate_by_truth_class", "no_cross_source_identity", ""] == 1 and n["truth_evidence", "top_rank_true", ""] == 2


def test_demand_follows_truth_through_the_stages(spark):
    k = kept(spark, ("A1", "B3", REVIEW, 1), ("A1", "B1", REVIEW, 2), ("A2", "B3", REVIEW, 1))
    more = k.select("a_row_id", "b_row_id").union(spark.createDataFrame([("A2", "B2")], PAIR))
    n = counts(A.demand_rows(*truths(spark, A3, B3), more, k, k.where("false")))
    assert n["truth_evidence", "retained_true_alternative", ""] == 1 and n["truth_evidence", "generated_true_not_retained", ""] == 1
    assert counts(A.demand_rows(*truths(spark, A3, B3), k, k, k.where("false")))["truth_evidence", "true_not_generated", ""] == 1


def test_demand_that_does_not_add_up_is_refused(spark):
    k = kept(spark, ("A1", "B1", AUTO, 1))
    rows = A.demand_rows(*truths(spark, A3, B3), k, k, k)
    A.reconciled(A.demand(rows))
    with pytest.raises(Invalid):
        A.reconciled(A.demand(rows.selectExpr("a_row_id", "bearing", "false AS automatic", "reviewed", "truth_class", "cause", "evidence", "gates")))


def test_bands(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in (0.0, 0.0199, 0.02, 0.1, 1.0, 1.5)], "x double")
    assert [r[0] for r in df.select(A.band(F.col("x"), A.MARGIN_EDGES)).collect()] == ["0.00-0.02", "0.00-0.02", "0.02-0.04", "0.10-1.00", "0.10-1.00", "0.10-1.00"]


def test_hard_negatives_go_both_ways_and_the_last_pattern_holds(spark):
    a, b = truths(spark, [("A1", "x"), ("A2", "y"), ("A3", "y")], [("B1", "x"), ("B2", "y")])
    patterns = spark.createDataFrame([(1, "x", "y", "first"), (2, "y", "x", "second"), (3, "x", "nowhere", "none")], "place int, left_entity string, right_entity string, pattern string")
    assert sorted(map(tuple, A.hard_negatives(a, b, patterns).collect())) == [("A1", "B2", "second"), ("A2", "B1", "second"), ("A3", "B1", "second")]


LOG = "session_id string, reviewer_id string, task_set_id string, arm string, place int, at_ms long, case_id string, action string, decision string"


def session(name, arm, *events):
    return [(name, f"r-{name}", "t", arm, i, ms, f"case-{c}", action, decision) for i, (ms, c, action, decision) in enumerate(events)]


STANDARD = session(
    "s", "standard_queue", (0, 1, "open_case", None), (10, 1, "inspect_candidate", None), (25, 1, "record_decision", "same_entity"), (30, 2, "open_case", None), (50, 2, "record_decision", "same_entity"),
    (55, 3, "open_case", None), (65, 3, "skip_case", None),
)
COLLISION = session(
    "c", "collision_inspector", (0, 1, "open_case", None), (5, 1, "open_collision", None), (12, 1, "inspect_candidate", None), (20, 1, "record_decision", "same_entity"), (25, 2, "open_case", None), (30, 2, "open_collision", None),
    (40, 2, "record_decision", "different_entity"), (45, 3, "open_case", None), (55, 3, "record_decision", "different_entity"),
)


def labels(spark):
    return spark.createDataFrame([("case-1", "same_entity"), ("case-2", "different_entity"), ("case-3", "same_entity")], "case_id string, expected string")


def test_study_by_arm(spark):
    log = spark.createDataFrame(STANDARD + COLLISION, LOG)
    found = {r.arm: r for r in study.arms(study.checked(log, labels(spark)), labels(spark)).collect()}
    s, c = found["standard_queue"], found["collision_inspector"]
    assert (s.sessions, s.reviewers, s.cases, s.decisions, s.skipped, s.correct, s.false_positive, s.false_negative, s.median_ms, s.navigation, s.same_cases) == (1, 1, 3, 2, 1, 1, 1, 0, 22.5, 1, True)
    assert (c.cases, c.decisions, c.correct, c.false_positive, c.false_negative, c.median_ms, c.navigation, c.navigation_per_decision) == (3, 3, 2, 0, 1, 15.0, 3, 1.0)
    empty = study.arms(log.where("false"), labels(spark)).collect()
    assert [(r.sessions, r.median_ms, r.accuracy, r.same_cases) for r in empty] == [(0, None, None, False)] * 2


@pytest.mark.parametrize(
    "code,events",
    [
        ("time_not_monotonic", [(5, 1, "open_case", None), (4, 1, "skip_case", None)]), ("time_not_monotonic", [(-1, 1, "open_case", None)]), ("unlabeled_case", [(0, 9, "open_case", None)]), ("unknown_action", [(0, 1, "dance", None)]),
        ("invalid_decision", [(0, 1, "open_case", None), (1, 1, "record_decision", "maybe")]), ("unexpected_decision", [(0, 1, "open_case", "same_entity")]), ("case_still_open", [(0, 1, "open_case", None), (1, 2, "open_case", None)]),
        ("case_revisited", [(0, 1, "open_case", None), (1, 1, "skip_case", None), (2, 1, "open_case", None)]), ("case_not_open", [(0, 1, "skip_case", None)]), ("case_not_open", [(0, 1, "open_case", None), (1, 2, "skip_case", None)]),
        ("collision_in_standard_arm", [(0, 1, "open_case", None), (1, 1, "open_collision", None)]), ("case_unclosed", [(0, 1, "open_case", None)]),
    ],
)
def test_study_refuses_logs_that_break_its_rules(spark, code, events):
    log = spark.createDataFrame(STANDARD + session("bad", "standard_queue", *events), LOG)
    assert [(r.session_id, r.code) for r in study.violations(log, labels(spark)).collect()] == [("bad", code)]
    assert {r.session_id for r in study.valid(log, labels(spark)).collect()} == {"s"}
    with pytest.raises(Invalid, match=code):
        study.checked(log, labels(spark))


def test_snapshots_are_compared_only_where_they_may_be(spark):
    keys = dict.fromkeys(baseline.KEYS, "x")
    one, two = (spark.createDataFrame([("candidate_recall", int(4 * v), 4, v), ("review_rate", 0, 0, None)], "metric string, numerator long, denominator long, value double") for v in (0.5, 0.75))
    found = {r.metric: r for r in baseline.compared(one, two, keys, keys).collect()}
    assert found["candidate_recall"].delta == 0.25 and found["review_rate"].delta is None and found["review_rate"].compatible
    other = baseline.compared(one, two, keys, keys | {"candidate_config": "y"}).collect()
    assert {(r.delta, r.compatible, r.reasons) for r in other} == {(None, False, "Different candidate configuration.")}
    assert baseline.snapshot_id(one, keys, "m") == baseline.snapshot_id(one, keys, "m") != baseline.snapshot_id(two, keys, "m")
    with pytest.raises(Invalid):
        baseline.compared(one, two, keys, {})


def test_trusted_table_waits_for_all_decisions(spark):
    gate = spark.createDataFrame([(2, 1, 0, False)], "undecided long, unresolved long, double_claims long, ready boolean")
    with pytest.raises(Invalid, match="trusted_export_not_ready"):
        layouts.trusted_layout(None, None, None, None, None, gate, (), layouts.Versions("m", "c", "v", "a", "b"))


def test_exported_parts_are_ranges_of_the_whole(spark, tmp_path):
    rows = spark.createDataFrame([("only_b", "", "B1", "=x"), ("same_entity", "A2", "B2", "a,b"), ("needs_review", "A9", "B3", "-5"), ("only_a", "A1", "", 'q"'), ("different_entity", "A3", "B4", ""), ("deferred", "A4", "B5", "")], "identity_status string, a_row_id string, b_row_id string, v string")
    layouts.write_reconciliation(rows.repartition(3), (tmp_path / "out").as_uri())
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split("\r\n")[:-1] == ["identity_status,a_row_id,b_row_id,v", 'same_entity,A2,B2,"a,b"', "different_entity,A3,B4,", "deferred,A4,B5,", "needs_review,A9,B3,-5", 'only_a,A1,,"q"""', "only_b,,B1,'=x"]


def test_artifacts_and_the_holdout_s_guard(spark, tmp_path):
    import json

    from weftlink.sources import artifacts

    keys = dict.fromkeys(baseline.KEYS, "x")
    one, two = (spark.createDataFrame([("candidate_recall", 1, 2, v), ("review_rate", 0, 0, None)], "metric string, numerator long, denominator long, value double") for v in (0.5, 0.75))
    errors = spark.createDataFrame([("candidate_misses", "A1"), ("false_unmatched", "A2")], "group string, a_row_id string")
    out = tmp_path.as_uri() + "/out"
    assert artifacts.write_artifacts(out, {"new": two, "old": one}, baseline.compared(one, two, keys, keys), {"new": errors}) == ["catalog.json", "errors/new", "report.json", "summary.md"]
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert [r["delta"] for r in report["comparison"]] == [0.25, None] and report["snapshots"]["new"][0]["value"] == 0.75
    assert "| candidate_recall | 0.5000 | 0.7500 | 0.2500 |" in (tmp_path / "out" / "summary.md").read_text() and "| review_rate | – | 0 / 0 |" in (tmp_path / "out" / "summary.md").read_text()
    assert {r.a_row_id for r in spark.read.parquet(out + "/errors/new").where("group = 'false_unmatched'").collect()} == {"A2"}
    with pytest.raises(Invalid):
        artifacts.write_artifacts(out, {}, baseline.compared(one, two, keys, keys), {"new": errors})
    baseline.check_holdout(True, "tune", "holdout")
    for wrong in ((False, "tune", "holdout"), (True, "same", "same")):
        with pytest.raises(Invalid):
            baseline.check_holdout(*wrong)


def test_a_sitting_ends_to_the_microsecond(spark):
    rows = [(1, 1, "2024-01-01 00:00:00.1"), (1, 2, "2024-01-01 00:30:00.1"), (1, 3, "2024-01-01 01:00:00.2"), (2, 4, "2024-01-01 00:00:00"), (2, 5, None)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts string")
    got = {(r.user_id, r.sitting): (r.n_events, r.seconds) for r in evaluate.sessions(events).collect()}
    assert got == {(1, 1): (2, 1800), (1, 2): (1, 0), (2, 1): (2, 0)}


def test_strongest_field_with_and_without_a_cost_of_places(spark):
    fields = spark.createDataFrame([("c", "first", 0, 0.300, 0.0), ("c", "last", 5, 0.304, 0.0), ("d", "first", 0, 0.0, 0.0), ("d", "last", 5, 0.0, 0.002)], "candidate_id string, mapping_id string, place int, plus double, minus double")
    pick = lambda **k: {r.candidate_id: (r.supporting, r.contradicting) for r in review.strongest(fields, **k).collect()}
    assert pick() == {"c": ("last", None), "d": (None, "last")}
    assert pick(per_place=1000) == {"c": ("first", None), "d": (None, "last")}
