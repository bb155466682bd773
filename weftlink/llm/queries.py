"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, conversations, decontamination, main_text, near_dedup, pitman_yor, quality_classifier, quality_rules, secret_scan, sharding, token_files, toxicity
from .common import documents


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_vocabularies() -> quality_rules.Rules:
    return quality_rules.Rules({"piece": tokenizer_path("piece_bpe_32k.model"), "bpe": tokenizer_path("byte_bpe_multi_50k.tiktoken")})


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.language_model_scores(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), quality_vocabularies())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.bpe_round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


SHARDING_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, CAST('0x' || substr(md5('shard-' || i || '#start'), 1, 8) AS BIGINT) % {sharding.SLOTS} AS start,
         CAST('0x' || substr(md5('shard-' || i || '#skip'), 1, 8) AS BIGINT) % {sharding.SLOTS - 1} + 1 AS skip
  FROM range({sharding.SHARDS}) r(i)),
preferred AS (
  SELECT i, list_transform(range({sharding.SLOTS}), lambda x: (start + x * skip) % {sharding.SLOTS}) AS slots FROM shards),
turns(n, i, slot, free) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), list_transform(range({sharding.SLOTS}), lambda x: true)
  UNION ALL
  SELECT n + 1, i2, s2, list_transform(range({sharding.SLOTS}), lambda x: free[x + 1] AND x <> s2)
  FROM (SELECT t.n, t.free, p.i AS i2, list_filter(p.slots, lambda x: t.free[x + 1])[1] AS s2
        FROM turns t JOIN preferred p ON p.i = t.n % {sharding.SHARDS} WHERE t.n < {sharding.SLOTS})),
placed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT d.doc_id, d.slot, CAST(t.i AS INTEGER) AS shard FROM placed d JOIN turns t ON t.slot = d.slot AND t.n > 0
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_language_model, op3_secret_scan, op4_token_files, op5_sharding, op6_toxicity, op7_near_dedup, op8_quality_rules, op9_quality_classifier, op10_bpe, op11_main_text, op12_conversations, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontamination.ORACLE_SQL, "op5_sharding": SHARDING_SQL, "op12_conversations": conversations.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
