"""Candidate generation: blocking keys, counted buckets, and equi-joins of the buckets that are small enough.

Buckets are counted by a partially aggregated group-by and dropped whole before any rows of the two sides meet, so a hot
key costs two counters and never a product.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.plans.model import STOP_TOKENS, CandidateConfig, Invalid, Mapping, identity


def prepared(df: DataFrame, side: str, mappings: Sequence[Mapping], id_column: str = "row_id") -> DataFrame:
    """row_id, and for each identity mapping its raw value v_<id> and normalized value n_<id>: once for each row, before any join.

    Rows of ASCII text only are normalized in the JVM; the others' values are folded first, which is one vectorised pass.
    Rows are dealt out first: they are small and dear, and a file of some megabytes is one task as Spark reads it.
    """
    used = identity(mappings)
    column = lambda m: m.a_column if side == "A" else m.b_column
    raw = [F.coalesce(F.col(column(m)).cast("string"), F.lit("")).alias(f"v_{m.mapping_id}") for m in used]
    rows = df.select(F.col(id_column).alias("row_id"), *raw).repartition(_tasks(df), "row_id")
    ascii_only = reduce(lambda x, y: x & y, [N.is_ascii(F.col(f"v_{m.mapping_id}")) for m in used])
    plain = rows.where(ascii_only).withColumns({f"n_{m.mapping_id}": N.of_kind(m.kind, F.col(f"v_{m.mapping_id}")) for m in used})
    others = rows.where(~ascii_only).withColumns({f"f_{m.mapping_id}": N.folded(F.col(f"v_{m.mapping_id}")) for m in used})
    others = others.withColumns({f"n_{m.mapping_id}": N.of_kind(m.kind, F.col(f"f_{m.mapping_id}"), unicode=True) for m in used})
    return plain.union(others.select(*plain.columns))


def _tasks(df: DataFrame) -> int:
    """Two for each core."""
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def dealt(found: DataFrame) -> DataFrame:
    """Pairs over all cores, as they are small and dear to compare; those of a row of A stay together."""
    return found.repartition(2 * _tasks(found), "a_row_id")


def _each(values: Column, make) -> Column:
    """Keys made from each element of an array."""
    return F.transform(values, make)


def _one(condition: Column, key: Column) -> Column:
    return F.when(condition, F.array(key)).otherwise(F.array().cast("array<string>"))


def _joined(arrays: list[Column]) -> Column:
    return F.concat(*arrays) if arrays else F.array().cast("array<string>")


def key_arrays(mappings: Sequence[Mapping], config: CandidateConfig = CandidateConfig()) -> dict[str, Column]:
    """For each blocker the keys of a prepared row; empty values give none."""
    if any(not m.matching for m in mappings):
        raise Invalid("a comparison mapping can't make keys")
    value = lambda m: F.col(f"n_{m.mapping_id}")
    exact = lambda m, tag: _one(value(m) != "", F.concat(F.lit(f"{m.mapping_id}:{tag}:"), value(m)))
    of = lambda *kinds: [m for m in mappings if m.kind in kinds]
    names, contacts, addresses, places = of("name", "name_or_title"), of("contact_person"), of("address"), of("postal", "city", "region", "geography")
    location = _joined([_one(value(m) != "", F.concat(F.lit(f"{m.kind}:"), value(m))) for m in places])
    number = _joined([_one(N.address_number(value(m)) != "", N.address_number(value(m))) for m in addresses])
    token = lambda m: N.meaningful(value(m), STOP_TOKENS)
    compact = lambda m: _one(N.compact(value(m)) != "", N.compact(value(m)))
    cross = lambda left, right, between: F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat(x, F.lit(between), y))))

    supporting = [exact(m, "source-local") for m in of("source_local_identifier")]
    strong = [exact(m, m.kind) for m in of("phone", "email", "domain")]
    strong += [_one(value(m) != "", F.concat(F.lit(f"{m.mapping_id}:email-domain:"), N.email_domain(value(m)))) for m in of("email")]
    if config.engine >= 4:
        supporting += [exact(m, "supporting") for m in of("categorical", "numeric", "date_or_timestamp", "free_text", "unknown")]
    if config.engine >= 3:
        strong += [exact(m, "generic-exact") for m in of("other")]
    own = lambda m: F.array(F.concat(F.lit(f"{m.mapping_id}:"), value(m)))
    context = [F.when(value(m) != "", F.concat(cross(own(m), location, ":location:"), cross(own(m), number, ":number:"))).otherwise(F.array().cast("array<string>")) for m in contacts]
    prefix = [_one(F.length(N.compact(value(m))) >= config.prefix, F.concat(F.lit("prefix:"), F.substring(N.compact(value(m)), 1, config.prefix))) for m in names]
    prefix += [_each(F.filter(token(m), lambda t: F.length(t) >= config.prefix), lambda t: F.concat(F.lit("token-prefix:"), F.substring(t, 1, config.prefix))) for m in names]
    numbered = F.transform(number, lambda n: F.concat(F.lit("number:"), n))
    by_name = lambda at, compacts: _joined([x for m in names for x in ([cross(at, token(m), ":token:")] + ([cross(at, compact(m), ":compact-name:")] if compacts else []))])
    made = {
        "persistent_exact_v1": _joined([exact(m, "identifier") for m in of("persistent_identifier")]),
        "exact_supporting_v1": _joined(supporting),
        "supporting_context_v1": _joined(context),
        "exact_strong_v1": _joined(strong),
        "name_token_v1": _joined([_each(token(m), lambda t: F.concat(F.lit("token:"), t)) for m in names]),
        "name_character_v1": _joined(prefix),
        "location_name_v1": by_name(location, False),
        "location_name_v2": by_name(location, True),
        "address_name_v1": by_name(numbered, False),
        "address_name_v2": by_name(numbered, True),
    }
    return {b: made[b] for b in config.blockers}


def keys(rows: DataFrame, mappings: Sequence[Mapping], config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """row_id, blocker_id, key: each key of a row once."""
    arrays = key_arrays(identity(mappings), config)
    tag = lambda blocker: lambda k: F.struct(F.lit(blocker).alias("blocker_id"), k.alias("key"))
    tagged = [F.transform(F.array_distinct(made), tag(blocker)) for blocker, made in arrays.items()]
    return rows.select("row_id", F.explode(F.concat(*tagged)).alias("k")).select("row_id", "k.blocker_id", "k.key")


def buckets(a_keys: DataFrame, b_keys: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """blocker_id, key, n_a, n_b and suppressed of every key that both sides have."""
    sided = a_keys.select("blocker_id", "key", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b_keys.select("blocker_id", "key", F.lit(0).alias("a"), F.lit(1).alias("b")))
    both = sided.groupBy("blocker_id", "key").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).where("n_a > 0 AND n_b > 0")
    return both.withColumn("suppressed", (F.col("n_a") > config.max_side) | (F.col("n_b") > config.max_side) | (F.col("n_a") * F.col("n_b") > config.max_pairs))


def relationships(a_keys: DataFrame, b_keys: DataFrame, counted: DataFrame) -> DataFrame:
    """a_row_id, b_row_id, blocker_id, key_hash for every pair of every bucket that isn't suppressed."""
    used = counted.where("NOT suppressed").select("blocker_id", "key")
    a = a_keys.join(used, ["blocker_id", "key"], "left_semi").withColumnRenamed("row_id", "a_row_id")
    b = b_keys.withColumnRenamed("row_id", "b_row_id")
    return a.join(b, ["blocker_id", "key"]).select("a_row_id", "b_row_id", "blocker_id", N.key_hash(F.col("key")).alias("key_hash"))


def pairs(related: DataFrame) -> DataFrame:
    """Each pair once, with its id and its sorted blocking evidence."""
    evidence = F.array_sort(F.collect_set(F.struct("blocker_id", "key_hash")))
    return related.groupBy("a_row_id", "b_row_id").agg(evidence.alias("blocking_evidence")).withColumn("candidate_id", N.candidate_id(F.col("a_row_id"), F.col("b_row_id")))


def diagnostics(counted: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """For each enabled blocker, in order: keys considered, used and suppressed, and the relationships of each."""
    n = F.col("n_a") * F.col("n_b")
    sums = counted.groupBy("blocker_id").agg(
        F.count("*").alias("keys_considered"), F.count_if(~F.col("suppressed")).alias("keys_used"), F.count_if("suppressed").alias("keys_suppressed"),
        F.sum(F.when(~F.col("suppressed"), n).otherwise(0)).alias("generated"), F.sum(F.when(F.col("suppressed"), n).otherwise(0)).alias("held_back"),
    )
    enabled = counted.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, config.blockers))).alias("place", "blocker_id"))
    zero = {c: 0 for c in ("keys_considered", "keys_used", "keys_suppressed", "generated", "held_back")}
    return enabled.join(sums, "blocker_id", "left").fillna(zero)


def without_candidates(rows: DataFrame, found: DataFrame, side: str) -> DataFrame:
    """row_id of the rows of a side that no pair has."""
    return rows.select("row_id").join(found.select(F.col(f"{side.lower()}_row_id").alias("row_id")), "row_id", "left_anti")


def all_pairs(a: DataFrame, b: DataFrame, most: int = 4_000_000) -> DataFrame:
    """Every pair, for evaluation on small inputs only: refuses more than `most`."""
    if a.count() * b.count() > most:
        raise Invalid("all pairs are for small evaluations")
    both = a.select(F.col("row_id").alias("a_row_id")).crossJoin(b.select(F.col("row_id").alias("b_row_id")))
    mark = F.substring(F.sha2(F.concat(F.lit("all-pairs"), F.char(F.lit(0)), "a_row_id", F.char(F.lit(0)), "b_row_id"), 256), 1, 16)
    return both.withColumn("blocking_evidence", F.array(F.struct(F.lit("all_pairs").alias("blocker_id"), mark.alias("key_hash")))).withColumn("candidate_id", N.candidate_id(F.col("a_row_id"), F.col("b_row_id")))
