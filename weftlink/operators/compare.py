"""Field evidence and scores of candidate pairs: wide, one group of columns for each mapping, no shuffle after the join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.functions import similarity as S
from weftlink.plans.model import CONFLICTS, STRONG_FAMILIES, WEIGHTS, Invalid, Mapping, identity

EXACT_ONLY = ("persistent_identifier", "source_local_identifier", "categorical", "numeric", "date_or_timestamp", "free_text", "unknown", "phone", "domain")
NAMES, PLACES = ("name", "name_or_title", "contact_person"), ("city", "region", "postal", "geography")
COMMON_SHARE = 0.05


def joined(found: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with both sides' prepared values, as a_… and b_…."""
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])
    return found.join(side(a, "a"), "a_row_id").join(side(b, "b"), "b_row_id")


def with_tokens(paired: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds jaccard_<x> and overlap_<x> of the values' distinct tokens; each value is split once for each pair."""
    sizes = {f"{n}_{x}": c for x, v in values.items() for n, c in zip(("left", "right", "both"), S.token_sizes(*v), strict=True)}
    out = paired.withColumns(sizes)
    of = lambda x: [F.col(f"{n}_{x}") for n in ("left", "right", "both")]
    out = out.withColumns({f"{n}_{x}": f(*of(x)) for x in values for n, f in (("jaccard", S.jaccard), ("overlap", S.overlap))})
    return out.drop(*sizes)


def _strengths(m: Mapping, a: Column, b: Column) -> tuple[Column, Column]:
    """Positive and conflicting strength of two values that are both there and differ."""
    ratio, jaccard, overlap = (F.col(f"{x}_{m.mapping_id}") for x in ("ratio", "jaccard", "overlap"))
    raw = F.col(f"raw_{m.mapping_id}")
    zero, one = F.lit(0.0), F.lit(1.0)
    kind = m.kind
    if kind in EXACT_ONLY or (kind == "email" and m.family is not None):
        return zero, one
    if kind == "email":
        local = (F.substring_index(a, "@", 1) == F.substring_index(b, "@", 1)).cast("double")
        host = (N.email_domain(a) == N.email_domain(b)).cast("double")
        return 0.7 * local + 0.3 * host, 1 - 0.5 * local - 0.2 * host
    if kind in PLACES:
        return F.when(ratio >= 0.88, 0.5 * ratio).otherwise(zero), one
    if kind in NAMES:
        return 0.45 * ratio + 0.4 * jaccard + 0.15 * overlap, F.greatest(zero, 0.55 - raw)
    if kind == "address":
        x, y = N.address_number(a), N.address_number(b)
        given = (x != "") & (y != "")
        agree, differ = (given & (x == y)).cast("double"), (given & (x != y)).cast("double")
        return 0.35 * agree + 0.25 * jaccard + 0.15 * overlap + 0.25 * ratio, F.greatest(differ, 0.35 * (1 - raw))
    return 0.55 * ratio + 0.3 * jaccard + 0.15 * overlap, F.greatest(zero, 0.5 - raw)


def needs_ratio(m: Mapping) -> bool:
    return m.kind not in EXACT_ONLY and m.kind != "email"


def needs_tokens(m: Mapping) -> bool:
    return needs_ratio(m) and m.kind not in PLACES


def evidence(paired: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """For each mapping x: class_x, positive_x, conflict_x (strengths), plus_x and minus_x (weighted)."""
    if any(not m.matching for m in mappings):
        raise Invalid("a comparison mapping can't make evidence")
    value = lambda m: (F.col(f"a_n_{m.mapping_id}"), F.col(f"b_n_{m.mapping_id}"))
    out = paired.withColumns({f"ratio_{m.mapping_id}": S.character_ratio(*value(m)) for m in mappings if needs_ratio(m)})
    out = with_tokens(out, {m.mapping_id: value(m) for m in mappings if needs_tokens(m)})
    # step by step: what an expression reads more than once is a column before it
    out = out.withColumns({f"raw_{m.mapping_id}": _strengths(m, *value(m))[0] for m in mappings})
    strengths, weighted = {}, {}
    for m in mappings:
        a, b = value(m)
        there = (a != "") & (b != "")
        strengths[f"positive_{m.mapping_id}"] = F.when(~there, 0.0).when(a == b, 1.0).otherwise(S.bounded(F.col(f"raw_{m.mapping_id}")))
        strengths[f"conflict_{m.mapping_id}"] = F.when(~there | (a == b), 0.0).otherwise(S.bounded(_strengths(m, a, b)[1]))
    out = out.withColumns(strengths)
    for m in mappings:
        (a, b), i = value(m), m.mapping_id
        positive, conflict = F.col(f"positive_{i}"), F.col(f"conflict_{i}")
        weighted[f"class_{i}"] = (
            F.when((a == "") & (b == ""), "missing_both").when(a == "", "missing_left").when(b == "", "missing_right")
            .when(a == b, "exact_agreement").when((positive >= 0.35) & (positive >= conflict), "partial_agreement").otherwise("conflict")
        )
        weighted[f"plus_{i}"] = S.rounded(positive * WEIGHTS[m.kind])
        weighted[f"minus_{i}"] = S.rounded(conflict * (WEIGHTS[m.kind] * CONFLICTS[m.kind]))
    return out.withColumns(weighted).drop(*[f"{x}_{m.mapping_id}" for m in mappings for x in ("raw", "jaccard", "overlap")])


def _total(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, columns, F.lit(0.0))


def scored(compared: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Score over the weights of all identity mappings, agreeing fields, and strong contradictions."""
    of = lambda name: [F.col(f"{name}_{m.mapping_id}") for m in mappings]
    weight = sum(WEIGHTS[m.kind] for m in mappings)
    agree = [(c.isin("exact_agreement", "partial_agreement") & (p > 0)).cast("int") for c, p in zip(of("class"), of("plus"), strict=True)]
    against = [(F.col(f"class_{m.mapping_id}") == "conflict") & (F.col(f"minus_{m.mapping_id}") > 0) for m in mappings if m.kind in ("persistent_identifier", "email", "domain")]
    return compared.withColumn("score", (_total(of("plus")) - _total(of("minus"))) / weight).withColumns(
        {
            "score": S.bounded(F.col("score")),
            "agreements": reduce(lambda x, y: x + y, agree, F.lit(0)),
            "contradiction": reduce(lambda x, y: x | y, against, F.lit(False)),
        }
    )


def tall(compared: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """One row for each pair and mapping, for views of evidence."""
    fields = [
        F.struct(
            F.lit(i).alias("place"), F.lit(m.mapping_id).alias("mapping_id"), F.lit(m.kind).alias("kind"), F.col(f"a_v_{m.mapping_id}").alias("a_value"), F.col(f"b_v_{m.mapping_id}").alias("b_value"),
            F.col(f"a_n_{m.mapping_id}").alias("a_norm"), F.col(f"b_n_{m.mapping_id}").alias("b_norm"),
            F.col(f"class_{m.mapping_id}").alias("class"), F.col(f"positive_{m.mapping_id}").alias("positive"), F.col(f"plus_{m.mapping_id}").alias("plus"), F.col(f"minus_{m.mapping_id}").alias("minus"),
        )
        for i, m in enumerate(mappings)
    ]
    out = compared.select("candidate_id", "a_row_id", "b_row_id", F.explode(F.array(*fields)).alias("e")).select("candidate_id", "a_row_id", "b_row_id", "e.*")
    return out.withColumns({"contribution": S.rounded(F.col("plus") - F.col("minus")), "code": code(), "outcome": outcome(), "label": label()})


def code() -> Column:
    """Explanation code of a field's class."""
    end = F.when(F.col("class") == "exact_agreement", "exact").when(F.col("class") == "partial_agreement", "partial").otherwise(F.col("class"))
    return F.concat_ws("_", "kind", end)


def outcome() -> Column:
    """The five-valued outcome: both missing sides in one."""
    return F.when(F.col("class") == "exact_agreement", "exact").when(F.col("class") == "partial_agreement", "similar").when(F.col("class") == "conflict", "different").when(F.col("class") == "missing_both", "both_missing").otherwise("one_missing")


def label() -> Column:
    """A reviewer's word for a field's evidence."""
    return F.when(F.col("class") == "exact_agreement", "Exact").when((F.col("class") == "partial_agreement") & (F.col("positive") >= 0.85), "Strong agreement").when(F.col("class") == "partial_agreement", "Partial").when(F.col("class") == "conflict", "Conflict").otherwise("Missing")


def frequencies(rows: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """mapping_id, value, n, and total of the side's values that aren't empty. One partially aggregated shuffle."""
    values = F.explode(F.array(*[F.struct(F.lit(m.mapping_id).alias("mapping_id"), F.col(f"n_{m.mapping_id}").alias("value")) for m in mappings]))
    counted = rows.select(values.alias("f")).select("f.*").where("value <> ''").groupBy("mapping_id", "value").agg(F.count("*").alias("n"))
    totals = counted.groupBy("mapping_id").agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(totals), "mapping_id")  # one row for each mapping


def information(fields: DataFrame, a_counts: DataFrame, b_counts: DataFrame) -> DataFrame:
    """Adds each field's frequencies on either side and its information class; scores don't use it."""
    side = lambda df, s: df.select("mapping_id", F.col("value").alias(f"{s}_norm"), F.col("n").alias(f"freq_{s}"), F.col("total").alias(f"total_{s}"))
    out = fields.join(side(a_counts, "a"), ["mapping_id", "a_norm"], "left").join(side(b_counts, "b"), ["mapping_id", "b_norm"], "left")
    share = F.greatest(F.col("freq_a") / F.col("total_a"), F.col("freq_b") / F.col("total_b"))
    most = F.greatest("freq_a", "freq_b")
    kind = F.when(F.col("class").startswith("missing"), "not_applicable").when(most.isNull(), "unknown").when(most <= 1, "distinctive").when(share >= COMMON_SHARE, "common").otherwise("repeated")
    return out.withColumn("information", kind).drop("total_a", "total_b")


def evidence_plan(a: DataFrame, b: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """For each mapping its comparator and, on either side, non-empty and distinct values, top count, and shared values."""
    x, y = frequencies(a, mappings), frequencies(b, mappings)
    stats = lambda df, s: df.groupBy("mapping_id").agg(F.max("total").alias(f"values_{s}"), F.count("*").alias(f"distinct_{s}"), F.max("n").alias(f"top_{s}"))
    shared = x.select("mapping_id", "value").join(y.select("mapping_id", "value"), ["mapping_id", "value"], "left_semi").groupBy("mapping_id").agg(F.count("*").alias("shared_values"))
    listed = a.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(m.mapping_id).alias("mapping_id"), F.lit(m.kind).alias("comparator")) for m in mappings])).alias("m")).select("m.*")
    out = listed.join(stats(x, "a"), "mapping_id", "left").join(stats(y, "b"), "mapping_id", "left").join(shared, "mapping_id", "left")
    return out.fillna(0)


def legacy_strength(normalizer: str, a: Column, b: Column, ratio: Column) -> Column:
    """The older comparator: equal, or similar from a ratio of 0.65."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when((F.lit(normalizer) == "text") & (ratio >= 0.65), ratio).otherwise(0.0)


def is_strong(kind: Column) -> Column:
    return kind.isin(*STRONG_FAMILIES)


