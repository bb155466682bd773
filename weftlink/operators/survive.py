"""Which value survives: conflicts of linked records, deterministic rules, resolutions, and the gate of the merged table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.normalize import instant, missing
from weftlink.plans.model import FieldPolicy, Invalid, Mapping, Policy


def linked_values(links: DataFrame, a: DataFrame, b: DataFrame, mappings: Sequence[Mapping], id_column: str = "row_id") -> DataFrame:
    """Each link with the raw values of its merge fields, one row for each field."""
    merge = [m for m in mappings if m.merge]
    left = a.select(F.col(id_column).alias("a_row_id"), *[F.col(m.a_column).alias(f"a_{m.mapping_id}") for m in merge])
    right = b.select(F.col(id_column).alias("b_row_id"), *[F.col(m.b_column).alias(f"b_{m.mapping_id}") for m in merge])
    raw = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields = F.array(*[F.struct(F.lit(m.mapping_id).alias("mapping_id"), raw(f"a_{m.mapping_id}").alias("a_value"), raw(f"b_{m.mapping_id}").alias("b_value")) for m in merge])
    return links.join(left, "a_row_id").join(right, "b_row_id").select("candidate_id", "a_row_id", "b_row_id", "source", F.explode(fields).alias("f")).select("candidate_id", "a_row_id", "b_row_id", "source", "f.*")


def conflicts(values: DataFrame) -> DataFrame:
    """Fields whose raw strings differ; nothing is normalized here."""
    return values.where("a_value <> b_value").withColumn("conflict_id", F.concat_ws("-", F.lit("conflict"), "candidate_id", "mapping_id"))


def _rule(f: FieldPolicy) -> Column:
    """(chosen, reason) of one strategy; chosen is A, B, both or null."""
    a, b = missing(F.col("a_value")), missing(F.col("b_value"))
    pick = lambda chosen, reason: F.struct(F.lit(chosen).cast("string").alias("chosen"), F.lit(reason).alias("reason"))
    if f.strategy == "keep_both":
        return pick("both", "kept_both")
    if f.strategy == "prefer_non_null":
        return F.when(a & ~b, pick("B", "non_null_b")).when(b & ~a, pick("A", "non_null_a")).when(a & b, pick(None, "both_missing")).otherwise(pick(None, "both_present"))
    if f.strategy == "prefer_trusted_source":
        return F.when(a if f.trusted == "A" else b, pick(None, "trusted_missing")).otherwise(pick(f.trusted, f"trusted_{f.trusted.lower()}"))
    if f.strategy == "prefer_newest":
        x, y = F.col("a_instant"), F.col("b_instant")
        return F.when(x.isNull() | y.isNull(), pick(None, "timestamp_unusable")).when(x == y, pick(None, "timestamps_equal")).when(x > y, pick("A", "newer_a")).otherwise(pick("B", "newer_b"))
    raise Invalid(f.strategy)


def preview(found: DataFrame, policy: Policy, resolutions: DataFrame | None = None, a: DataFrame | None = None, b: DataFrame | None = None, id_column: str = "row_id") -> DataFrame:
    """What each rule makes of each conflict; what a person or an earlier rule resolved stays as it is.

    resolutions: conflict_id, chosen, origin (manual or deterministic_rule); current ones only.
    """
    out = found.withColumns({"a_instant": F.lit(None).cast("long"), "b_instant": F.lit(None).cast("long")})
    newest = [f for f in policy.fields if f.strategy == "prefer_newest"]
    for side, df in (("a", a), ("b", b)):
        if newest and df is not None:
            columns = {getattr(f, f"{side}_timestamp") for f in newest}
            times = df.select(F.col(id_column).alias(f"{side}_row_id"), *[instant(F.col(c)).alias(f"_t_{c}") for c in columns])
            value = F.lit(None).cast("long")
            for f in newest:
                value = F.when(F.col("mapping_id") == f.mapping_id, F.col(f"_t_{getattr(f, f'{side}_timestamp')}")).otherwise(value)
            out = out.join(times, f"{side}_row_id", "left").withColumn(f"{side}_instant", value).drop(*[f"_t_{c}" for c in columns])
    rule, rule_id = F.lit(None).cast("struct<chosen:string,reason:string>"), F.lit(None).cast("string")
    for f in policy.fields:
        here = F.col("mapping_id") == f.mapping_id
        rule, rule_id = F.when(here, _rule(f)).otherwise(rule), F.when(here, F.lit(policy.rule_id(f.mapping_id))).otherwise(rule_id)
    out = out.withColumns({"ruled": rule, "rule_id": rule_id})
    if resolutions is not None:
        out = out.join(resolutions.select("conflict_id", F.col("chosen").alias("kept"), F.col("origin").alias("kept_origin")), "conflict_id", "left")
    else:
        out = out.withColumns({"kept": F.lit(None).cast("string"), "kept_origin": F.lit(None).cast("string")})
    chosen = F.coalesce("kept", F.col("ruled.chosen"))
    reason = F.when(F.col("kept_origin") == "manual", "manual_preserved").when(F.col("kept").isNotNull(), "existing_preserved").otherwise(F.coalesce(F.col("ruled.reason"), F.lit("no_rule")))
    origin = F.when(F.col("kept").isNotNull(), F.col("kept_origin")).when(F.col("ruled.chosen").isNotNull(), "deterministic_rule")
    value = F.when(chosen == "A", F.col("a_value")).when(chosen == "B", F.col("b_value")).when(chosen == "both", F.concat_ws(" | ", "a_value", "b_value"))
    return out.select("conflict_id", "candidate_id", "mapping_id", "a_value", "b_value", chosen.alias("chosen"), value.alias("value"), reason.alias("reason"), origin.alias("origin"), "rule_id")


def current(log: DataFrame, key: str) -> DataFrame:
    """The latest entry of each key of an append-only log with a seq; cleared ones are gone."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return log.withColumn("_n", last).where("_n = 1").drop("_n")


def summary(previewed: DataFrame) -> DataFrame:
    """For each field its conflicts, what is resolved, and a rule that would settle the rest."""
    open_ = F.col("chosen").isNull()
    one_missing = missing(F.col("a_value")) != missing(F.col("b_value"))
    out = previewed.groupBy("mapping_id").agg(
        F.count("*").alias("conflicts"), F.count_if(~open_).alias("resolved"), F.count_if(open_).alias("unresolved"), F.count_if(F.col("origin") == "manual").alias("manual"), F.bool_and(F.when(open_, one_missing)).alias("settled_by_presence"),
    )
    return out.withColumn("suggested_rule", F.when(F.col("settled_by_presence"), "prefer_non_null")).drop("settled_by_presence")


def readiness(items: DataFrame, previewed: DataFrame, double: DataFrame) -> DataFrame:
    """One row: whether the merged table may be written, and how much stands in its way."""
    undecided = items.where("state IN ('needs_review', 'deferred')").agg(F.count("*").alias("undecided"))
    unresolved = previewed.where("chosen IS NULL").agg(F.count("*").alias("unresolved"))
    claims = double.agg(F.count("*").alias("double_claims"))
    # three one-row aggregates side by side
    row = undecided.join(F.broadcast(unresolved)).join(F.broadcast(claims))
    return row.withColumn("ready", (F.col("undecided") == 0) & (F.col("unresolved") == 0) & (F.col("double_claims") == 0))


def state_token(previewed: DataFrame) -> str:
    """A hash of the previewed state, whatever the order of rows: applying asks for the token that the preview gave."""
    h = previewed.select(F.xxhash64("conflict_id", "chosen", "reason").alias("x"), F.hash("conflict_id", "chosen", "reason").alias("y"))
    row = h.agg(F.count("*"), F.sum(F.col("x").cast("decimal(38,0)")), F.sum(F.col("y").cast("long"))).first()
    from weftlink.plans.model import canonical_hash

    return canonical_hash([str(v) for v in row])


def applied(previewed: DataFrame, token: str) -> DataFrame:
    """The resolutions that a preview adds; a stale token is refused."""
    if state_token(previewed) != token:
        raise Invalid("the preview is stale")
    return previewed.where("chosen IS NOT NULL AND origin = 'deterministic_rule' AND reason <> 'existing_preserved'").select("conflict_id", "chosen", "value", "reason", "origin", "rule_id")


def merged(links: DataFrame, values: DataFrame, previewed: DataFrame) -> DataFrame:
    """Surviving value of every merge field of every link: the common one, or the resolved one."""
    chosen = previewed.select("candidate_id", "mapping_id", "chosen", F.col("value").alias("resolved"))
    out = values.join(chosen, ["candidate_id", "mapping_id"], "left")
    return out.select("candidate_id", "a_row_id", "b_row_id", "mapping_id", F.when(F.col("a_value") == F.col("b_value"), F.col("a_value")).otherwise(F.col("resolved")).alias("value"), F.coalesce("chosen", F.when(F.col("a_value") == F.col("b_value"), F.lit("equal"))).alias("chosen"))
