"""Column profiles: one pass of conditional aggregates, and one group-by for values, over all columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.plans.model import Mapping

# What counts as a value of each inferred type; a column has the first type that all its values have.
TYPES = {
    "integer": r"^[+-]?\d+$",
    "number": r"^[+-]?(\d+(_?\d)*(\.(\d+(_?\d)*)?)?|\.\d+(_?\d)*)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$",
    "boolean": r"^(?i:true|false|yes|no)$",
    "date": r"^(\d{4}-?\d{2}-?\d{2}|\d{4}-?W\d{2}(-?\d)?)([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$",
}
# Shapes that nine tenths of the values must have, in the order of ties.
SHAPES = {
    "uuid_like": r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
    "email_like": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone_like": r"^[+()\d .-]{7,}$",
    "short_code": r"^[A-Za-z0-9_-]{1,12}$",
}


def melted(df: DataFrame, columns: Sequence[str], order: Column) -> DataFrame:
    """row_index, column and value of every cell; blank cells have null values."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns]))
    return df.select(order.alias("row_index"), cells.alias("cell")).select("row_index", "cell.column", F.when(~N.missing(F.col("cell.value")), F.col("cell.value")).alias("value"))


def profile(df: DataFrame, columns: Sequence[str], order: Column) -> DataFrame:
    """One row for each column. Rates of nulls and distinct values are of all rows, others of populated ones."""
    cells = melted(df, columns, order)
    share = lambda pattern: F.avg(F.when(F.col("value").isNotNull(), F.trim("value").rlike(pattern).cast("double")))
    is_type = {t: F.coalesce(F.bool_and(F.trim("value").rlike(p)), F.lit(False)) for t, p in TYPES.items()}
    base = cells.groupBy("column").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"), F.round(F.avg(F.char_length("value")), 3).alias("average_length"),
        *[c.alias(f"is_{t}") for t, c in is_type.items()], *[share(p).alias(f"share_{s}") for s, p in SHAPES.items()],
    )
    raw = cells.where("value IS NOT NULL").groupBy("column", "value").agg(F.min("row_index").alias("first"), F.count("*").alias("n"))
    normal = raw.groupBy("column", N.text(F.col("value")).alias("normal")).agg(F.sum("n").alias("n")).groupBy("column").agg(F.count("*").alias("normalized_distinct"), F.max("n").alias("most_common"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("first"))
    sampled = raw.withColumn("place", place).where("place <= 3").groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "|").alias("samples"))
    distinct = raw.groupBy("column").agg(F.count("*").alias("distinct_count"))
    early = cells.where("value IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("row_index"))).where("place <= 100")
    texty = early.groupBy("column").agg(F.bool_and(F.col("value").contains(" ") | (F.char_length("value") > 24)).alias("texty"))
    out = base
    for other in (distinct, normal, sampled, texty):
        out = out.join(other, "column", "left")
    populated = F.col("row_count") - F.col("null_count")
    rate = lambda n, d: F.when(d > 0, F.round(n / d, 6)).otherwise(0.0)
    kind = F.when(populated == 0, "unknown")
    for t in TYPES:
        kind = kind.when(F.col(f"is_{t}"), t)
    out = out.withColumn("inferred_type", kind.otherwise("string"))
    best = F.greatest(*[F.col(f"share_{s}") for s in SHAPES])
    shape = F.when(populated == 0, "empty").when(F.col("inferred_type").isin("integer", "number"), "numeric").when(F.col("inferred_type") == "date", "date_like")
    for s in SHAPES:
        shape = shape.when((best >= 0.9) & (F.col(f"share_{s}") == best), s)
    counts = ("distinct_count", "normalized_distinct", "most_common")
    return out.fillna(0, list(counts)).select(
        "column", "row_count", "null_count", rate(F.col("null_count"), F.col("row_count")).alias("null_rate"), "distinct_count", rate(F.col("distinct_count"), F.col("row_count")).alias("distinct_rate"),
        "normalized_distinct", rate(F.col("normalized_distinct"), populated).alias("normalized_rate"), "most_common", rate(F.col("most_common"), populated).alias("most_common_rate"),
        F.coalesce("average_length", F.lit(0.0)).alias("average_length"), F.coalesce("samples", F.lit("")).alias("samples"), "inferred_type", shape.when(F.col("texty"), "text").otherwise("mixed").alias("pattern_shape"),
    )


def setup_warnings(mappings: Sequence[Mapping], a: DataFrame, b: DataFrame) -> DataFrame:
    """mapping_id (empty for the whole plan) and warning, from the two profiles."""
    spark = a.sparkSession
    used = [m for m in mappings if m.matching]
    kinds = {m.kind for m in used}
    whole = ["no_matching_field"] if not used else []
    whole += ["name_only"] if kinds and kinds <= {"name", "name_or_title"} else []
    whole += ["single_signal"] if len(used) == 1 else []
    whole += ["weak_families_only"] if used and kinds <= {"contact_person", "geography", "categorical", "source_local_identifier", "free_text", "unknown"} else []
    plan = spark.createDataFrame([("", w) for w in whole], "mapping_id string, warning string")
    fields = spark.createDataFrame([(m.mapping_id, m.a_column, m.b_column, m.kind) for m in used], "mapping_id string, a_column string, b_column string, kind string")
    side = lambda df, s: df.select(F.col("column").alias(f"{s}_column"), *[F.col(c).alias(f"{s}_{c}") for c in ("null_count", "row_count", "distinct_count", "most_common_rate")])
    joined = fields.join(side(a, "a"), "a_column").join(side(b, "b"), "b_column")
    repeated = lambda s: F.col(f"{s}_distinct_count") < F.col(f"{s}_row_count") - F.col(f"{s}_null_count")
    found = F.array_compact(
        F.array(
            F.when((F.col("kind") == "persistent_identifier") & (repeated("a") | repeated("b")), "duplicate_persistent_values"),
            F.when((F.col("a_null_count") > 0) | (F.col("b_null_count") > 0), "missing_values"),
            F.when(F.col("kind") == "source_local_identifier", "source_local_in_matching"),
            F.when(F.col("kind").isin("categorical", "numeric", "date_or_timestamp", "free_text", "unknown") & (F.col("a_most_common_rate") >= 0.05) & (F.col("b_most_common_rate") >= 0.05), "common_supporting_values"),
        )
    )
    return plan.union(joined.select("mapping_id", F.explode(found).alias("warning")))
