"""CSV and JSON readers: every cell a string, short rows padded, over-wide rows and bad headers refused."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.plans.model import Invalid


def header(spark: SparkSession, path: str) -> list[str]:
    """The first record's cells; they must be there, not blank, and unique."""
    first = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    if not first:
        raise Invalid("the file has no header")
    cells = next(csv.reader([first[0][0].lstrip("﻿").rstrip("\r")]))
    if any(not c.strip() for c in cells) or len({c.strip() for c in cells}) < len(cells):
        raise Invalid("header cells must be unique and not blank")
    return cells


def read_csv(spark: SparkSession, path: str, side: str) -> DataFrame:
    """row_index (from 0, in file order), row_id and one string column for each header cell.

    A row's id is its first cell without surrounding blanks, else its side and position; ids must be unique.
    """
    names = header(spark, path)
    schema = ", ".join(f"`{c}` string" for c in [*names, "_over"]) + ", `_bad` string"
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True, encoding="UTF-8")
    placed = raw.withColumn("_place", F.monotonically_increasing_id()).cache()
    if placed.where(F.col("_over").isNotNull()).limit(1).count():
        raise Invalid("a row is wider than the header")
    # file order is kept within a split and between splits, so positions follow from each split's size
    sizes = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = placed.withColumn("p", F.shiftright("_place", 33).cast("int")).join(F.broadcast(sizes.select("p", "before")), "p")
    rows = rows.withColumn("row_index", F.col("before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names]
    first = F.trim(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")))
    row_id = F.when(first != "", first).otherwise(F.concat(F.lit(f"{side}-"), (F.col("row_index") + 1).cast("string")))
    out = rows.select("row_index", row_id.alias("row_id"), *[c for c, n in zip(cells, names, strict=True) if n not in ("row_id", "row_index")])
    if out.groupBy("row_id").count().where("count > 1").limit(1).count():
        raise Invalid("row ids must be unique")
    return out


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each source file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_truth(spark: SparkSession, path: str, side: str) -> DataFrame:
    """row_id and entity_id of one side of a JSON document of arrays a and b, for evaluation only."""
    return spark.read.json(path, multiLine=True).select(F.explode(side.lower()).alias("t")).select(F.col("t.row_id").alias("row_id"), F.col("t.entity_id").alias("entity_id"))
