"""Review studies: recorded sessions checked against the rules of the log, and what each arm's reviewers made of the cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.plans.model import Invalid

from .evaluate import _ratio

ARMS = ("standard_queue", "collision_inspector")
ACTIONS = ("open_case", "inspect_candidate", "open_collision", "record_decision", "skip_case")
CLOSING, DECISIONS = ("record_decision", "skip_case"), ("same_entity", "different_entity")


def violations(log: DataFrame, labels: DataFrame) -> DataFrame:
    """session_id, place and code of the first event of each session that breaks a rule; a session without one is valid.

    log: session_id, reviewer_id, task_set_id, arm, place, at_ms, case_id, action, decision; labels: case_id, expected.
    Cases are worked one after the other, so all an event's rules need is what the session's events before it have opened
    and closed: running counts in one window.
    """
    order = Window.partitionBy("session_id").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    opens, closes = c("action") == "open_case", c("action").isin(*CLOSING)
    known = labels.select("case_id", F.lit(True).alias("labelled")).distinct()
    told = log.join(known, "case_id", "left").withColumns(
        {
            "ms_before": F.lag("at_ms").over(order), "open": F.coalesce(F.count_if(opens).over(before), F.lit(0)) > F.coalesce(F.count_if(closes).over(before), F.lit(0)),
            "at_case": F.last(F.when(opens, c("case_id")), ignorenulls=True).over(before), "arms": F.size(F.collect_set(F.struct("arm", "reviewer_id", "task_set_id")).over(Window.partitionBy("session_id"))),
            "last": F.lead("place").over(order).isNull(), "again": F.row_number().over(Window.partitionBy("session_id", "case_id", "action").orderBy("place")),
        }
    )
    decided = c("action") == "record_decision"
    code = (
        F.when(c("arms") > 1, "session_identity").when(~c("arm").isin(*ARMS), "unknown_arm").when(c("labelled").isNull(), "unlabeled_case").when(c("at_ms").isNull() | (c("at_ms") < 0) | (c("at_ms") < c("ms_before")), "time_not_monotonic")
        .when(~c("action").isin(*ACTIONS) | c("action").isNull(), "unknown_action").when(decided & (c("decision").isNull() | ~c("decision").isin(*DECISIONS)), "invalid_decision").when(~decided & c("decision").isNotNull(), "unexpected_decision")
        .when(opens & c("open"), "case_still_open").when(opens & (c("again") > 1), "case_revisited").when(~opens & (~c("open") | (c("at_case") != c("case_id"))), "case_not_open")
        .when((c("action") == "open_collision") & (c("arm") != "collision_inspector"), "collision_in_standard_arm").when(c("last") & ~closes, "case_unclosed")
    )
    return told.withColumn("code", code).where("code IS NOT NULL").groupBy("session_id").agg(F.min(F.struct(c("place").cast("long").alias("place"), "code")).alias("x")).select("session_id", "x.place", "x.code")


def valid(log: DataFrame, labels: DataFrame) -> DataFrame:
    """The events of sessions that break no rule."""
    return log.join(violations(log, labels).select("session_id"), "session_id", "left_anti")


def checked(log: DataFrame, labels: DataFrame) -> DataFrame:
    """The log; refuses it if a session breaks a rule, or a case is labelled twice."""
    if not labels.groupBy("case_id").count().where("count > 1").isEmpty():
        raise Invalid("duplicate truth case")
    if first := violations(log, labels).orderBy("session_id").first():
        raise Invalid(f"session {first.session_id}: {first.code} at event {first.place}")
    return log


def arms(log: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each arm of a valid log: sessions, cases, decisions, errors, exact median time, and navigation.

    same_cases: whether both arms saw the same cases. Descriptive only: nothing here supports a causal claim.
    """
    c = F.col
    seen = log.groupBy("arm", "session_id", "case_id").agg(
        F.min("reviewer_id").alias("reviewer_id"), F.max("decision").alias("decision"), (F.max("at_ms") - F.min("at_ms")).alias("ms"), F.count_if(c("action").isin("inspect_candidate", "open_collision")).alias("nav")
    ).join(labels.select("case_id", "expected"), "case_id")
    done = c("decision").isNotNull()
    out = seen.groupBy("arm").agg(
        F.count_distinct("session_id").alias("sessions"), F.count_distinct("reviewer_id").alias("reviewers"), F.count_distinct("case_id").alias("unique_cases"), F.count("*").alias("cases"), F.count("decision").alias("decisions"),
        F.count_if(c("decision") == c("expected")).alias("correct"), F.count_if((c("decision") == "same_entity") & (c("expected") == "different_entity")).alias("false_positive"),
        F.count_if((c("decision") == "different_entity") & (c("expected") == "same_entity")).alias("false_negative"), F.percentile(F.when(done, c("ms")), F.lit(0.5)).alias("median_ms"), F.sum(F.when(done, c("nav"))).alias("navigation"),
    )
    covered = seen.groupBy("case_id").agg(F.count_distinct("arm").alias("n")).agg(F.coalesce(F.min("n") == 2, F.lit(False)).alias("same_cases"))
    listed = log.sparkSession.createDataFrame([(a,) for a in ARMS], "arm string")
    counts = ["sessions", "reviewers", "unique_cases", "cases", "decisions", "correct", "false_positive", "false_negative", "navigation"]
    out = listed.join(out, "arm", "left").fillna(0, counts).crossJoin(covered)  # one row
    return out.select(*["arm", *counts], (c("cases") - c("decisions")).alias("skipped"), _ratio(c("correct"), c("decisions")).alias("accuracy"), "median_ms", _ratio(c("navigation"), c("decisions")).alias("navigation_per_decision"), "same_cases")
