"""The two exported tables in full: every row's identity state or provenance, raw values, and how each field was settled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.plans.model import Invalid, Mapping, Policy

from .sinks import line

# Versions of the exports.
RECONCILIATION_VERSION, TRUSTED_VERSION = "reconciliation-export-v3.0.0", "trusted-merged-export-v2.0.0"


@dataclass(frozen=True)
class Versions:
    """What both exports say of where their rows come from."""

    matcher: str
    candidate_engine: str
    mapping: str
    source_a: str
    source_b: str
    policy: str = "manual-only"


FIXED = (
    "a_row_id", "b_row_id", "identity_status", "identity_decision_source", "identity_decision_id", "identity_decided_at", "review_state", "candidate_id", "match_score", "collision",
    "matcher_version", "candidate_engine_version", "mapping_version", "source_a_sha256", "source_b_sha256", "survivorship_policy_version", "export_version",
)
PER_FIELD = ("resolved", "conflict_id", "resolution_id", "field_status", "resolution_strategy", "resolution_source", "resolution_origin", "resolution_reason", "survivorship_policy_version", "survivorship_rule_id")
TRUSTED_FIXED = (
    "entity_provenance", "a_row_id", "b_row_id", "identity_source", "identity_decision_id", "mapping_version", "source_a_sha256", "source_b_sha256", "candidate_engine_version", "matcher_version", "survivorship_policy_version", "export_version"
)
TRUSTED_FIELD = ("", "__A", "__B", "__resolution", "__resolution_source", "__resolution_origin", "__resolution_id", "__policy_version", "__rule_id", "__reason")


def _label(m: Mapping) -> str:
    return m.label or m.mapping_id


def _decided(decisions: DataFrame) -> DataFrame:
    """Decisions with an id and a time, empty where they have none."""
    text = lambda c: F.col(c).cast("string") if c in decisions.columns else F.lit("")
    return decisions.select("candidate_id", "decision", F.coalesce(text("decision_id"), F.lit("")).alias("decision_id"), F.coalesce(text("decided_at"), F.lit("")).alias("decided_at"))


def _settled(previewed: DataFrame, policy: Policy | None, fields: Sequence[Mapping]) -> DataFrame:
    """One row for each candidate with a struct f_<id> for each field in conflict; the tall preview goes through one shuffle."""
    strategy = F.lit(None).cast("string")
    for f in policy.fields if policy else ():
        strategy = F.when(F.col("mapping_id") == f.mapping_id, f.strategy).otherwise(strategy)
    manual = F.col("origin") == "manual"
    by_hand = F.when(F.col("chosen") == "A", "use_a").when(F.col("chosen") == "B", "use_b").otherwise("keep_both")
    one = F.struct(
        F.coalesce("value", F.lit("")).alias("value"), "conflict_id", F.col("chosen").isNotNull().alias("done"), F.when(manual, by_hand).otherwise(strategy).alias("strategy"), F.when(manual, "human").otherwise("rule").alias("source"),
        "origin", "reason", F.when(manual, "").otherwise(policy.version if policy else "").alias("policy"), F.when(manual, "").otherwise(F.coalesce("rule_id", F.lit(""))).alias("rule"),
    )
    return previewed.groupBy("candidate_id").agg(*[F.max_by(F.when(F.col("mapping_id") == m.mapping_id, one), F.when(F.col("mapping_id") == m.mapping_id, 1)).alias(f"f_{m.mapping_id}") for m in fields])


def _sides(a: DataFrame, b: DataFrame, mappings: Sequence[Mapping], id_column: str) -> tuple[DataFrame, DataFrame]:
    one = lambda df, s, column: df.select(F.col(id_column).alias(f"{s}_row_id"), *[F.coalesce(F.col(column(m)).cast("string"), F.lit("")).alias(f"{s}_{m.mapping_id}") for m in mappings])
    return one(a, "a", lambda m: m.a_column), one(b, "b", lambda m: m.b_column)


def _ten(values: Sequence[Column | str], names: Sequence[str]) -> list[Column]:
    return [(F.lit(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, names, strict=True)]


def reconciliation_layout(
    a: DataFrame, b: DataFrame, kept: DataFrame, links: DataFrame, decisions: DataFrame, items: DataFrame, previewed: DataFrame, mappings: Sequence[Mapping], versions: Versions, policy: Policy | None = None, id_column: str = "row_id"
) -> DataFrame:
    """17 columns, two for each mapping and ten for each merge mapping; rows linked, different, under review, only in A, only in B."""
    raw_a, raw_b = _sides(a, b, mappings, id_column)
    decided = _decided(decisions)
    c, none = F.col, F.lit("")
    pairs = kept.select("candidate_id", "a_row_id", "b_row_id", "score", "collision")
    state = lambda status, source, did, at, review: [x.alias(n) for x, n in zip((status, source, did, at, review), FIXED[2:7], strict=True)]
    facts = ["candidate_id", "a_row_id", "b_row_id", "score", "collision"]
    human = c("source") == "human"
    same = decided.where("decision = 'same_entity'")
    linked = links.select("candidate_id", "source").join(pairs, "candidate_id").join(same, "candidate_id", "left").select(
        *facts, *state(F.lit("same_entity"), c("source"), F.coalesce("decision_id", none), F.coalesce("decided_at", none), F.when(human, "reviewed_same").otherwise("system_established")), F.lit("linked").alias("kind")
    )
    different = decided.where("decision = 'different_entity'").join(pairs, "candidate_id").join(items.select("a_row_id", "state"), "a_row_id", "left").select(
        *facts, *state(F.lit("different_entity"), F.lit("human"), c("decision_id"), c("decided_at"), F.coalesce("state", F.lit("reviewed_different"))), F.lit("different").alias("kind")
    )
    open_items = items.where("state IN ('needs_review', 'deferred')").join(links.select("a_row_id"), "a_row_id", "left_anti")
    deferred = c("state") == "deferred"
    review = open_items.select("candidate_id", "state").join(pairs, "candidate_id").select(
        *facts, *state(c("state"), F.when(deferred, "human_defer").otherwise("pending_human_review"), none, none, c("state")), F.when(deferred, "deferred").otherwise("review").alias("kind")
    )
    taken = lambda side: links.select(f"{side}_row_id").union(open_items.select(f"{side}_row_id"))
    alone = lambda df, side: df.select(F.col(id_column).alias(f"{side}_row_id")).join(taken(side), f"{side}_row_id", "left_anti")
    lone = lambda df, side: alone(df, side).select(
        none.alias("candidate_id"), *[(c(f"{s}_row_id") if s == side else none).alias(f"{s}_row_id") for s in "ab"], F.lit(None).cast("double").alias("score"), F.lit(False).alias("collision"),
        *state(F.lit(f"only_{side}"), F.lit("none"), none, none, F.lit("source_only")), F.lit(f"only_{side}").alias("kind"),
    )
    fields = [m for m in mappings if m.merge]
    rows = reduce(DataFrame.unionByName, [linked, different, review, lone(a, "a"), lone(b, "b")])
    rows = rows.join(raw_a, "a_row_id", "left").join(raw_b, "b_row_id", "left").join(_settled(previewed, policy, fields), "candidate_id", "left")
    raw = {f"{s}_{m.mapping_id}": F.coalesce(c(f"{s}_{m.mapping_id}"), none) for s in "ab" for m in mappings}
    fixed = {
        "a_row_id": c("a_row_id"), "b_row_id": c("b_row_id"), **{n: c(n) for n in FIXED[2:7]}, "candidate_id": c("candidate_id"), "match_score": F.coalesce(c("score").cast("string"), none), "collision": c("collision").cast("string"),
        "matcher_version": F.lit(versions.matcher), "candidate_engine_version": F.lit(versions.candidate_engine), "mapping_version": F.lit(versions.mapping), "source_a_sha256": F.lit(versions.source_a), "source_b_sha256": F.lit(versions.source_b),
        "survivorship_policy_version": F.lit(versions.policy), "export_version": F.lit(RECONCILIATION_VERSION),
    }
    out = [v.alias(n) for n, v in fixed.items()] + [raw[f"{s}_{m.mapping_id}"].alias(f"{s}_{_label(m)}") for m in mappings for s in "ab"]
    kind = c("kind")
    status = F.when(kind.isin("review", "deferred"), "pending_identity").otherwise("not_applicable")
    origin = F.when(kind == "different", "identity_different").when(kind.isin("review", "deferred"), "unresolved").otherwise(F.concat(F.lit("source_"), kind))
    why = (
        F.when(kind == "different", "Human review determined that these records are different entities.").when(kind == "deferred", "Identity review was explicitly deferred.").when(kind == "review", "Identity is not resolved.")
        .otherwise("No cross-source conflict.")
    )
    for m in fields:
        f = lambda n, m=m: c(f"f_{m.mapping_id}.{n}")
        held, done = c(f"f_{m.mapping_id}").isNotNull(), f("done")
        ways = [
            (kind != "linked", [none, none, none, status, none, origin, origin, why, none, none]),
            (held & done, [f("value"), f("conflict_id"), F.concat(F.lit("resolution-"), f("conflict_id")), F.lit("resolved"), f("strategy"), f("source"), f("origin"), f("reason"), f("policy"), f("rule")]),
            (held, [none, f("conflict_id"), none, F.lit("unresolved"), none, F.lit("unresolved"), F.lit("unresolved"), F.lit("No survivorship decision has been applied."), none, none]),
        ]
        equal = [raw[f"a_{m.mapping_id}"], none, none, F.lit("agreed"), F.lit("agreed"), F.lit("equal_sources"), F.lit("source_equality"), F.lit("Source values are equal."), none, none]
        for i, name in enumerate(PER_FIELD):
            value = equal[i]
            for test, given in reversed(ways):
                value = F.when(test, given[i]).otherwise(value)
            out.append(value.alias(f"{name}_{_label(m)}"))
    return rows.select(*out)


def trusted_layout(
    a: DataFrame, b: DataFrame, links: DataFrame, decisions: DataFrame, previewed: DataFrame, ready: DataFrame, mappings: Sequence[Mapping], versions: Versions, policy: Policy | None = None, id_column: str = "row_id"
) -> DataFrame:
    """12 columns and ten for each merge mapping, of links and rows of one source; refused until all is settled.

    ready: the row of `survive.readiness`.
    """
    gate = ready.first()  # one row
    if not gate["ready"]:
        raise Invalid(f"trusted_export_not_ready: {gate['undecided']} identity review item(s), {gate['unresolved']} conflict(s) and {gate['double_claims']} doubled claim(s) remain")
    fields = [m for m in mappings if m.merge]
    raw_a, raw_b = _sides(a, b, fields, id_column)
    c, none = F.col, F.lit("")
    same = _decided(decisions).where("decision = 'same_entity'").select("candidate_id", "decision_id")
    linked = links.join(same, "candidate_id", "left").select("candidate_id", "a_row_id", "b_row_id", F.lit("confirmed_cross_source").alias("kind"), c("source").alias("identity"), F.coalesce("decision_id", none).alias("decision_id"))
    lone = lambda df, side: df.select(F.col(id_column).alias(f"{side}_row_id")).join(links.select(f"{side}_row_id"), f"{side}_row_id", "left_anti").select(
        none.alias("candidate_id"), *[(c(f"{s}_row_id") if s == side else none).alias(f"{s}_row_id") for s in "ab"], F.lit(f"source_only_{side}").alias("kind"), F.lit("none").alias("identity"), none.alias("decision_id")
    )
    rows = reduce(DataFrame.unionByName, [linked, lone(a, "a"), lone(b, "b")])
    rows = rows.join(raw_a, "a_row_id", "left").join(raw_b, "b_row_id", "left").join(_settled(previewed, policy, fields), "candidate_id", "left")
    version = {"mapping_version": versions.mapping, "source_a_sha256": versions.source_a, "source_b_sha256": versions.source_b, "candidate_engine_version": versions.candidate_engine, "matcher_version": versions.matcher, "survivorship_policy_version": versions.policy, "export_version": TRUSTED_VERSION}
    out = [c("kind").alias("entity_provenance"), c("a_row_id"), c("b_row_id"), c("identity").alias("identity_source"), c("decision_id").alias("identity_decision_id"), *[F.lit(version[n]).alias(n) for n in TRUSTED_FIXED[5:]]]
    joined = c("kind") == "confirmed_cross_source"
    for m in fields:
        x, y = (F.coalesce(c(f"{s}_{m.mapping_id}"), none) for s in "ab")
        f = lambda n, m=m: c(f"f_{m.mapping_id}.{n}")
        alone = [F.when(c("kind") == "source_only_a", x).otherwise(y), x, y, c("kind"), c("kind"), c("kind"), none, none, none, F.lit("No cross-source conflict.")]
        equal = [x, x, y, F.lit("agreed"), F.lit("equal_sources"), F.lit("source_equality"), none, none, none, F.lit("Source values are equal.")]
        settled = [f("value"), x, y, f("strategy"), f("source"), f("origin"), F.concat(F.lit("resolution-"), f("conflict_id")), f("policy"), f("rule"), f("reason")]
        held = c(f"f_{m.mapping_id}").isNotNull()
        out += [F.when(~joined, p).when(held, q).otherwise(r).alias(f"{_label(m)}{n}") for n, p, q, r in zip(TRUSTED_FIELD, alone, settled, equal, strict=True)]
    return rows.select(*out)


def _write(layout: DataFrame, place: Column, path: str) -> None:
    """A heading, then rows by place and ids, as CSV lines; each part file is a range, so the parts in order are the whole."""
    lines = layout.select(place.alias("place"), "a_row_id", "b_row_id", line(layout.columns).alias("line"))
    heading = layout.sparkSession.createDataFrame([tuple(layout.columns)], ", ".join(f"`{n}` string" for n in layout.columns))
    first = heading.select(F.lit(0).alias("place"), F.lit("").alias("a_row_id"), F.lit("").alias("b_row_id"), line(layout.columns).alias("line"))
    first.union(lines).orderBy("place", "a_row_id", "b_row_id").select("line").write.option("lineSep", "\r\n").text(path)


def write_reconciliation(layout: DataFrame, path: str) -> None:
    """Linked rows first, then different, under review, only in A, only in B."""
    status = F.col("identity_status")
    place = F.when(status == "same_entity", 1).when(status == "different_entity", 2).when(status == "only_a", 4).when(status == "only_b", 5).otherwise(3)
    _write(layout, place, path)


def write_trusted(layout: DataFrame, path: str) -> None:
    kind = F.col("entity_provenance")
    _write(layout, F.when(kind == "confirmed_cross_source", 1).when(kind == "source_only_a", 2).otherwise(3), path)
