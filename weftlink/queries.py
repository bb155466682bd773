"""Queries of the reconciliation operators over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.operators import blocking, compare, decide
from weftlink.plans import oracle as O
from weftlink.plans.entities import MAPPINGS, sources
from weftlink.plans.match import Match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_MATCHES: dict[tuple[str, str], Match] = {}


def match(spark: SparkSession, sf_dir: str) -> Match:
    """One match for each session and folder of tables: its queries share what it has written, as long as that is there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MATCHES or not _MATCHES[key].readable():
        _MATCHES[key] = Match(*sources(spark, sf_dir), MAPPINGS)
    return _MATCHES[key]


def forget() -> None:
    """Removes what the matches have written; the next query starts anew."""
    while _MATCHES:
        _MATCHES.popitem()[1].remove()


# Normalizers

_NORMALIZED = {
    "fn01_normalize_text": ("name", N.text, O.text), "fn02_normalize_phone": ("phone", N.phone, O.phone), "fn03_normalize_email": ("email", N.email, O.email),
    "fn05_normalize_domain": ("website", N.domain, O.domain), "fn06_normalize_name": ("name", N.name, O.name), "fn07_normalize_postal": ("address", N.postal, O.postal),
    "fn08_normalize_address": ("address", N.address, O.address),
    "fn04_email_domain": ("email", lambda c: N.email_domain(N.email(c)), lambda c: f"split_part({O.email(c)}, '@', 2)"),
    "fn09_address_number": ("address", lambda c: N.address_number(N.address(c)), lambda c: O.number_of(O.address(c))),
    "fn10_meaningful_tokens": ("name", lambda c: F.array_join(N.meaningful(N.name(c), O.STOP_TOKENS), " "), lambda c: f"array_to_string(list_filter(string_split({O.name(c)}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(t) for t in O.STOP_TOKENS)})), ' ')"),
    "fn11_compact_name": ("name", lambda c: N.compact(N.name(c)), lambda c: O.compact(O.name(c))),
    "fn12_key_hash": ("name", lambda c: N.key_hash(N.name(c)), lambda c: f"substr(sha256({O.name(c)}), 1, 16)"),
    "fn14_legacy_phone": ("phone", lambda c: N.legacy(c, "phone"), lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"),
    "fn14_legacy_number": ("balance", lambda c: N.legacy(c, "number"), lambda c: c),
    "fn17_missing": ("ref", lambda c: N.missing(c).cast("int"), lambda c: f"CAST(trim({c}) = '' AS INTEGER)"),
    "fn18_instant": ("updated_at", N.instant, lambda c: f"CASE WHEN {c} LIKE '2024%' THEN epoch_ms(CAST(replace(replace({c}, 'T', ' '), 'Z', '') AS TIMESTAMP)) END"),
}

for _name, (_column, _spark, _sql) in _NORMALIZED.items():

    def _run(spark: SparkSession, sf_dir: str, column: str = _column, f=_spark) -> DataFrame:
        a, b = sources(spark, sf_dir)
        return a.select("row_id", F.col(column).alias("v")).union(b.select("row_id", F.col(column).alias("v"))).select("row_id", f(F.col("v")).alias("value"))

    query(_name, f"{O.chain('sources')} SELECT row_id, {_sql('v')} AS value FROM (SELECT row_id, {_column} AS v FROM a_src UNION ALL SELECT row_id, {_column} FROM b_src)")(_run)


_FOLDED = "replace(lower(coalesce(text, '')), 'ß', 'ss')"


@query("fn01_unicode_text", f"SELECT doc_id, sha256(trim(regexp_replace({_FOLDED}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))) AS text_sha256, sha256({O.name(_FOLDED)}) AS name_sha256 FROM documents")
def fn01_unicode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of four languages as text and as names: those of ASCII only stay in the JVM."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("v"))
    hashed = lambda df, c, unicode: df.select("doc_id", F.sha2(N.text(F.col(c), unicode), 256).alias("text_sha256"), F.sha2(N.name(F.col(c), unicode), 256).alias("name_sha256"))
    others = docs.where(~N.is_ascii(F.col("v"))).withColumn("f", N.folded(F.col("v")))
    return hashed(docs.where(N.is_ascii(F.col("v"))), "v", False).union(hashed(others, "f", True))


@query("src02_row_ids", f"{O.chain('sources')} SELECT 'A' AS side, count(*) AS n_rows, count(DISTINCT row_id) AS n_ids FROM a UNION ALL SELECT 'B', count(*), count(DISTINCT row_id) FROM b")
def src02_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda df, s: df.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids")).select(F.lit(s).alias("side"), "n_rows", "n_ids")
    a, b = sources(spark, sf_dir)
    return one(a, "A").union(one(b, "B"))


# Blocking


@query("blk09_inverted_index", f"{O.chain('pairs')} SELECT 'A' AS side, blocker_id, count(*) AS postings, count(DISTINCT key) AS n_keys FROM ka GROUP BY blocker_id UNION ALL SELECT 'B', blocker_id, count(*), count(DISTINCT key) FROM kb GROUP BY blocker_id")
def blk09_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda df, s: df.groupBy("blocker_id").agg(F.count("*").alias("postings"), F.count_distinct("key").alias("n_keys")).select(F.lit(s).alias("side"), "blocker_id", "postings", "n_keys")
    a, b = match(spark, sf_dir).keys
    return one(a, "A").union(one(b, "B"))


@query("blk10_bucket_suppression", f"{O.chain('pairs')} SELECT blocker_id, key, n_a, n_b, suppressed FROM buckets")
def blk10_bucket_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).buckets


@query("blk11_candidate_pairs", f"{O.chain('pairs')} SELECT candidate_id, a_row_id, b_row_id, evidence FROM pairs")
def blk11_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.array_join(F.transform("blocking_evidence", lambda e: F.concat_ws(":", e["blocker_id"], e["key_hash"])), ",")
    return match(spark, sf_dir).pairs.select("candidate_id", "a_row_id", "b_row_id", flat.alias("evidence"))


_PER_BLOCKER = "persistent_exact_v1 exact_supporting_v1 supporting_context_v1 exact_strong_v1 name_token_v1 name_character_v1 location_name_v2 address_name_v2".split()
for _n, _blocker in enumerate(_PER_BLOCKER, 1):

    def _run(spark: SparkSession, sf_dir: str, blocker: str = _blocker) -> DataFrame:
        m = match(spark, sf_dir)
        m = m.with_config(type(m.config)(blockers=(blocker,)))
        return blocking.relationships(*m.keys, m.buckets).select("a_row_id", "b_row_id", "key_hash")

    query(f"blk{_n:02d}_{_blocker}", f"{O.chain('pairs')} SELECT a_row_id, b_row_id, key_hash FROM related WHERE blocker_id = '{_blocker}'")(_run)


@query("blk12_diagnostics", f"""{O.chain('pairs')} SELECT CAST(place AS INTEGER) AS place, e.blocker_id, count(key) AS keys_considered, count(key) FILTER (NOT suppressed) AS keys_used, count(key) FILTER (suppressed) AS keys_suppressed,
  CAST(coalesce(sum(n_a * n_b) FILTER (NOT suppressed), 0) AS BIGINT) AS generated, CAST(coalesce(sum(n_a * n_b) FILTER (suppressed), 0) AS BIGINT) AS held_back
  FROM (SELECT unnest({_PER_BLOCKER}) AS blocker_id, unnest(range(8)) AS place) e LEFT JOIN buckets USING (blocker_id) GROUP BY ALL""")
def blk12_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.diagnostics(match(spark, sf_dir).buckets)


@query("blk13_without_candidates", f"{O.chain('pairs')} SELECT 'A' AS side, row_id FROM a WHERE row_id NOT IN (SELECT a_row_id FROM pairs) UNION ALL SELECT 'B', row_id FROM b WHERE row_id NOT IN (SELECT b_row_id FROM pairs)")
def blk13_without_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match(spark, sf_dir)
    a, b = (blocking.without_candidates(rows, m.pairs, s).select(F.lit(s).alias("side"), "row_id") for rows, s in zip(m.rows, "AB", strict=True))
    return a.union(b)


# Comparison and scores

for _m in MAPPINGS:

    def _run(spark: SparkSession, sf_dir: str, i: str = _m.mapping_id) -> DataFrame:
        return match(spark, sf_dir).compared.select("candidate_id", F.col(f"class_{i}").alias("class"), F.col(f"positive_{i}").alias("positive"), F.col(f"conflict_{i}").alias("conflict"), F.col(f"plus_{i}").alias("plus"), F.col(f"minus_{i}").alias("minus"))

    _i = _m.mapping_id
    query(f"cmp_{_m.kind}", f"{O.chain('scored')} SELECT candidate_id, class_{_i} AS class, p_{_i} AS positive, c_{_i} AS conflict, plus_{_i} AS plus, minus_{_i} AS minus FROM compared")(_run)


@query("sim01_character_ratio", f"{O.chain('scored')} SELECT candidate_id, r_name AS ratio FROM rated")
def sim01_character_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).compared.select("candidate_id", F.col("ratio_name").alias("ratio"))


@query("sim02_token_similarity", f"{O.chain('scored')} SELECT candidate_id, {O._jaccard('a_name', 'b_name')} AS jaccard, {O._overlap('a_name', 'b_name')} AS overlap FROM valued WHERE a_name <> '' AND b_name <> ''")
def sim02_token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match(spark, sf_dir)
    a, b = F.col("a_n_name"), F.col("b_n_name")
    paired = compare.joined(blocking.dealt(m.pairs.select("candidate_id", "a_row_id", "b_row_id")), *m.rows).where((a != "") & (b != ""))
    return compare.with_tokens(paired, {"name": (a, b)}).select("candidate_id", F.col("jaccard_name").alias("jaccard"), F.col("overlap_name").alias("overlap"))


@query("scr01_scores", f"{O.chain('scored')} SELECT candidate_id, a_row_id, b_row_id, score, agreements, contradiction FROM scored")
def scr01_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).scored.select("candidate_id", "a_row_id", "b_row_id", "score", "agreements", "contradiction")


@query("scr05_evidence_plan", f"""{O.chain('fields')} SELECT m.mapping_id, m.comparator, coalesce(x.v, 0) AS values_a, coalesce(x.d, 0) AS distinct_a, coalesce(x.t, 0) AS top_a, coalesce(y.v, 0) AS values_b, coalesce(y.d, 0) AS distinct_b, coalesce(y.t, 0) AS top_b,
  (SELECT count(*) FROM fa WHERE fa.mapping_id = m.mapping_id AND fa.value IN (SELECT value FROM fb WHERE fb.mapping_id = m.mapping_id)) AS shared_values
  FROM (SELECT unnest({[m.mapping_id for m in MAPPINGS]}) AS mapping_id, unnest({[m.kind for m in MAPPINGS]}) AS comparator) m
  LEFT JOIN (SELECT mapping_id, CAST(max(total) AS BIGINT) AS v, count(*) AS d, max(n) AS t FROM fa GROUP BY mapping_id) x USING (mapping_id) LEFT JOIN (SELECT mapping_id, CAST(max(total) AS BIGINT) AS v, count(*) AS d, max(n) AS t FROM fb GROUP BY mapping_id) y USING (mapping_id)""")
def scr05_evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match(spark, sf_dir)
    return compare.evidence_plan(*m.rows, m.identity)


@query("cmp10_information", f"{O.chain('fields')} SELECT candidate_id, mapping_id, kind, class, freq_a, freq_b, information, contribution FROM fields")
def cmp10_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).fields.select("candidate_id", "mapping_id", "kind", "class", "freq_a", "freq_b", "information", "contribution")


# Ranking and assignment


@query("rnk01_ranking", f"{O.chain('kept')} SELECT candidate_id, a_row_id, b_row_id, score, CAST(rank AS INTEGER) AS rank, margin, collision, band FROM ranked")
def rnk01_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).ranked.select("candidate_id", "a_row_id", "b_row_id", "score", "rank", "margin", "collision", "band")


@query("rnk05_retained", f"{O.chain('kept')} SELECT candidate_id, CAST(rank AS INTEGER) AS rank, score, band FROM kept")
def rnk05_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).kept.select("candidate_id", "rank", "score", "band")


@query("rnk06_source_only", f"{O.chain('kept')} SELECT 'A' AS side, row_id FROM a WHERE row_id NOT IN (SELECT a_row_id FROM kept) UNION ALL SELECT 'B', row_id FROM b WHERE row_id NOT IN (SELECT b_row_id FROM kept WHERE band = 'auto_match' AND rank = 1)")
def rnk06_source_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match(spark, sf_dir)
    return decide.only_a(m.rows[0], m.kept).select(F.lit("A").alias("side"), "row_id").union(decide.only_b(m.rows[1], m.kept).select(F.lit("B").alias("side"), "row_id"))


@query("asg01_one_to_one", f"{O.chain('kept')} SELECT candidate_id, a_row_id, b_row_id FROM auto")
def asg01_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(spark, sf_dir).automatic.select("candidate_id", "a_row_id", "b_row_id")


@query("asg02_legacy", f"{O.chain('kept')} SELECT candidate_id, a_row_id, b_row_id FROM kept WHERE rank = 1 AND band = 'auto_match'")
def asg02_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.legacy(match(spark, sf_dir).kept).select("candidate_id", "a_row_id", "b_row_id")
