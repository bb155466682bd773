"""The review journal: one run's commands in order, as the product's rules have them."""

from hashlib import sha256
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink import journal_queries
from weftlink.operators import decide, journal
from weftlink.plans.model import Invalid

KEPT = [("c1", "A1", "B1"), ("c2", "A1", "B2"), ("c3", "A2", "B1"), ("c4", "A3", "B3"), *[(f"x{i}", f"AX{i}", f"BX{i}") for i in range(25)]]


def run(spark, commands, auto=("c4",)):
    """Outcomes in order, and the state left."""
    kept = spark.createDataFrame(KEPT, "candidate_id string, a_row_id string, b_row_id string")
    rows = [("run-1", i, c[0], c[1] if isinstance(c[1], list) else [], c[1] if c[0] in ("defer", "restore") else None, c[2] if len(c) > 2 else None, c[1] if c[0] in ("resolve", "replace", "clear") else None) for i, c in enumerate((*c, None)[:3] if len(c) > 1 else (c[0], None, None) for c in commands)]
    conflicts = spark.createDataFrame([(f"conflict-{c}-name", c) for c in ("c1", "c4")], "conflict_id string, candidate_id string")
    fold = journal.folded(spark.createDataFrame(rows, journal.COMMANDS), kept, kept.where(kept.candidate_id.isin(*auto)), conflicts).collect()
    return [r.value for r in sorted((r for r in fold if r.kind == "outcome"), key=lambda r: r.seq)], sorted((r.kind, r.key, r.value) for r in fold if r.kind != "outcome")


SAME, DIFFERENT = "same_entity", "different_entity"


def test_single_decisions_keep_links_one_to_one(spark):
    got, left = run(spark, [("decide", ["c1"], SAME), ("decide", ["c1"], DIFFERENT), ("decide", ["c2"], SAME), ("decide", ["c3"], SAME), ("decide", ["c2"], DIFFERENT), ("decide", ["nope"], SAME)])
    assert got == ["accepted", "decision_exists", "identity_already_confirmed", "b_row_already_confirmed", "accepted", "candidate_not_found"]
    assert left == [("decision", "c1", SAME), ("decision", "c2", DIFFERENT)]


def test_batch_is_taken_or_refused_as_a_whole(spark):
    got, left = run(spark, [("decide", ["x1", "x2"], SAME), ("decide", ["x3", "c1", "c3"], SAME), ("defer", "AX4"), ("decide", ["x4", "x5"], DIFFERENT), ("undo",), ("undo",), ("undo",)])
    assert got == ["accepted", "b_row_already_confirmed", "accepted", "accepted", "accepted", "accepted", "nothing_to_undo"]
    assert left == [("deferral", "AX4", "deferred")]


def test_undo_is_blocked_by_a_later_resolution(spark):
    got, left = run(spark, [("decide", ["c1"], SAME), ("resolve", "conflict-c1-name"), ("undo",), ("resolve", "conflict-c1-name"), ("replace", "conflict-c1-name"), ("clear", "conflict-c1-name"), ("clear", "conflict-c1-name"), ("undo",), ("resolve", "conflict-c1-name")])
    assert got == ["accepted", "accepted", "undo_blocked_by_resolutions", "resolution_exists", "accepted", "accepted", "resolution_missing", "accepted", "conflict_not_found"] and left == []


def test_resolved_automatic_link_cannot_be_rejected(spark):
    got, left = run(spark, [("resolve", "conflict-c4-name"), ("decide", ["c4"], DIFFERENT), ("decide", ["c4"], SAME), ("undo",), ("clear", "conflict-c4-name"), ("undo",), ("decide", ["c4"], DIFFERENT), ("resolve", "conflict-c4-name")])
    assert got == ["accepted", "identity_change_blocked_by_resolutions", "accepted", "undo_blocked_by_resolutions", "accepted", "accepted", "accepted", "identity_not_confirmed"] and left == [("decision", "c4", DIFFERENT)]


def test_defer_and_restore(spark):
    got, left = run(spark, [("defer", "A1"), ("decide", ["c1"], SAME), ("undo",), ("restore", "A1"), ("defer", "A3"), ("defer", "nobody"), ("decide", ["c3"], DIFFERENT), ("defer", "A2"), ("defer", "A1"), ("launch",)])
    assert got == ["accepted", "accepted", "accepted", "accepted", "review_item_resolved", "review_item_not_found", "accepted", "review_item_resolved", "accepted", "unknown_action"]
    assert left == [("decision", "c3", DIFFERENT), ("deferral", "A1", "deferred")]


def test_twenty_undos(spark):
    got, left = run(spark, [("decide", [f"x{i}"], SAME) for i in range(25)] + [("undo",)] * 21)
    assert got == ["accepted"] * 45 + ["nothing_to_undo"] and [x[1] for x in left] == sorted(f"x{i}" for i in range(5))


def test_runs_are_apart_and_an_empty_log_is_nothing(spark):
    assert run(spark, []) == ([], [])


def test_doubled_claims_are_refused(spark):
    kept = spark.createDataFrame([(*x, 1, "needs_review", False) for x in KEPT], "candidate_id string, a_row_id string, b_row_id string, rank int, band string, collision boolean")
    made = lambda *ids: spark.createDataFrame([(i, SAME) for i in ids], "candidate_id string, decision string")
    assert {r.candidate_id for r in decide.checked_links(kept, decide.legacy(kept), made("c1", "c4")).collect()} == {"c1", "c4"}
    for wrong in (made("c1", "c2"), made("c1", "c3"), made("elsewhere")):
        with pytest.raises(Invalid, match="one_to_one_integrity_violation"):
            decide.checked_links(kept, decide.legacy(kept), wrong)
    found = {(r.side, r.row_id, r.candidates) for r in decide.violations(kept, made("c1", "c2", "c3")).collect()}
    assert found == {("A", "A1", "c1,c2"), ("B", "B1", "c1,c3")}


def test_batch_of_the_log_is_collected_once(spark):
    """Not once for each of its pairs, which is the square of a run's batch."""
    ids = [(f"candidate-{sha256(str(i).encode()).hexdigest()[:20]}", f"A-{i:09d}", f"B-{i:09d}") for i in range(2000)]
    kept = spark.createDataFrame(ids, "candidate_id string, a_row_id string, b_row_id string")
    log = journal_queries.log(SimpleNamespace(m=SimpleNamespace(a=kept, kept=kept)))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window" in line and "collect_list" in line]
    want = {f"run-{d}": sorted(c for c, a, _ in ids if a[-1] == str(d) and c[11] == "0") for d in range(10)}
    got = log.where(F.size("targets") > 1).collect()
    assert {r.run_id: r.targets for r in got} == want and len(got) == 10 and all(r.seq >= 1 and r.decision == SAME for r in got)


def test_commands_without_row_or_conflict_are_spread_over_tasks(spark):
    kept = spark.createDataFrame(KEPT, "candidate_id string, a_row_id string, b_row_id string")
    log = spark.createDataFrame([("run-1", i, "decide", [f"x{i % 25}"], None, SAME, None) for i in range(400)] + [("run-1", 400, "defer", [], "A1", None, None), ("run-1", 401, "clear", [], None, None, "conflict-c1-name")], journal.COMMANDS)
    conflicts = spark.createDataFrame([("conflict-c1-name", "c1")], "conflict_id string, candidate_id string")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = journal.with_facts(log, kept, kept.where("candidate_id = 'c4'"), conflicts).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    known = {r.seq: r for r in rows}
    assert len(rows) == len(known) == 402 and known[400].row.candidates == 2 and known[401].conflict.id == "c1"
    assert [t.id for t in known[7].targets] == ["x7"] and known[7].row is None and known[7].conflict is None and known[400].targets == []
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < 200


def test_commands_are_read_as_they_are():
    target = pa.struct([("id", pa.string()), ("a", pa.string()), ("auto", pa.bool_())])
    targets = pa.array([[{"id": "1", "a": None, "auto": False}], [], None, [{"id": "2", "a": "é", "auto": None}, None]] * 2, pa.list_(target))
    rows = pa.array([None, {"candidates": 2, "auto": True}, {"candidates": None, "auto": None}], pa.struct([("candidates", pa.int64()), ("auto", pa.bool_())]))
    for column in (targets, targets.slice(1, 5), targets.slice(3), rows, rows.slice(1), rows.slice(0, 1), pa.array([], target), pa.array([None, "é"]), pa.array([1, 2])):
        assert journal._values(column) == column.to_pylist()
