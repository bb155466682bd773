"""Benchmark decontamination by spaced-seed hashing, with DataFrame expressions only.

A seed is the hash of the words at the marked places of a fixed mask; the other places may differ. Every place of every
document and benchmark item gives one seed for each mask; items of under ten words also give the seed of all their words.
Documents' seeds pass a Bloom filter of the benchmark's (a bit array sized by their number, which a scalar subquery hands
to the scan; it drops no true match), then meet the benchmark's in an equi-join. Matches are brought down to one row for
each document, item and diagonal, which are written; only then are words fetched, and compared along the whole diagonal
from end to end of the item: the score is the best sum over a stretch, one for each equal word and minus one for each
substituted one. A pair is found from a score of `LEAST_SCORE`, or of the item's length if that is less.

Words are maximal runs of characters other than space and U+0009-000D of the lower-cased text. They are compared by
32-bit hashes, seeds by 64-bit ones.

Defined results: a null or empty text matches nothing, nor does a text of fewer words than the item's masks span;
repeated rows of a document or item count once (the best score of a pair of ids); null ids are ids like others; other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Marked places are ones. Six words must agree within nine or ten.
MASKS = ("111010011", "1011001011")
LEAST_SCORE = 10
#: The filter has about sixteen bits for a seed, between these numbers of 64-bit words (128 KB and 16 MB).
FILTER_WORDS = (1 << 14, 1 << 21)
#: Matches up to which their documents' ids are broadcast: at most 40 bytes each.
BROADCAST_ROWS = 500_000


def _hashed(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """The id, the array h of word hashes, and a hash of these."""
    words = F.split(F.btrim(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(" \t\n\u000b\f\r")), "[ \\x09-\\x0D]+")
    words = F.filter(words, lambda w: w != "")
    hashed = df.select(F.col(id_col).cast("long").alias(name), words.alias("words")).select(name, F.transform("words", lambda w: F.hash(w)).alias("h"))
    return hashed.withColumn(f"{name}_text", F.xxhash64("h"))


def _seeds(i: int, mask: str) -> str:
    """SQL for the array of (at, seed) of one mask over h."""
    places = ", ".join(f"get(h, at + {k})" for k, c in enumerate(mask) if c == "1")
    return f"transform(slice(h, 1, greatest(size(h) - {len(mask) - 1}, 0)), (x, at) -> struct(at AS at, xxhash64({i}, {places}) AS seed))"


def _bit(shift: int, words: int) -> tuple[str, str]:
    """SQL for the filter's word and bit that a seed has in one of two probes."""
    return f"CAST(shiftrightunsigned(seed, {shift}) & {words - 1} AS INT)", f"shiftleft(1L, CAST(shiftrightunsigned(seed, {shift + 22}) & 63 AS INT))"


def _filter_of(seeds: DataFrame, size: int) -> DataFrame:
    """One row: the bit array that holds two bits of every seed."""
    probes = [seeds.select(F.expr(word).alias("word"), F.expr(bit).alias("bit")) for word, bit in (_bit(s, size) for s in (0, 32))]
    words = probes[0].union(probes[1]).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    # dense, in the order of words: as many elements at all times
    full = seeds.sparkSession.range(size).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits"))


def _passes(size: int) -> str:
    return " AND ".join(f"get(bits, {w.replace('seed', 's.seed')}) & {b.replace('seed', 's.seed')} <> 0" for w, b in (_bit(s, size) for s in (0, 32)))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id and score of every document that holds a benchmark item's words."""
    items = _hashed(benchmark, item_col, item_text_col, "item_id").where("size(h) > 0").distinct()
    short = sorted(r[0] for r in items.where(f"size(h) < {LEAST_SCORE}").select(F.size("h")).distinct().collect())  # under ten numbers
    masks = [_seeds(i, m) for i, m in enumerate(MASKS)]
    whole = [_seeds(len(MASKS) + n, "1" * n) for n in short]
    own = ", ".join(masks + [f"IF(size(h) = {n}, {x}, slice({x}, 1, 0))" for n, x in zip(short, whole, strict=True)])
    item_seeds = items.select("item_id", "item_id_text", F.explode(F.expr(f"concat({own})")).alias("s")).select("item_id", "item_id_text", F.col("s.at").alias("item_at"), "s.seed")
    size = FILTER_WORDS[0]
    while size < FILTER_WORDS[1] and size * 4 < item_seeds.count():
        size *= 2
    texts = _hashed(docs, id_col, text_col, "doc_id")
    bits = _filter_of(item_seeds.select("seed"), size)
    passed = F.explode(F.expr(f"filter(concat({', '.join(masks + whole)}), s -> {_passes(size)})"))
    kept = texts.withColumn("bits", bits.scalar()).select("doc_id", "doc_id_text", passed.alias("s")).select("doc_id", "doc_id_text", F.col("s.at").alias("at"), "s.seed")
    lines = kept.join(item_seeds, "seed").select("doc_id", "doc_id_text", "item_id", "item_id_text", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    lines = written(lines, "lines")
    ids = lines.select(F.col("doc_id").alias("_id")).distinct()
    some = F.broadcast(ids) if lines.count() <= BROADCAST_ROWS else ids
    wanted = docs.join(some, docs[id_col].cast("long").eqNullSafe(F.col("_id")), "left_semi")
    h = _hashed(wanted, id_col, text_col, "doc_id").distinct().withColumnRenamed("h", "words")
    both = lines.join(items.withColumnRenamed("h", "item_words"), lines["item_id"].eqNullSafe(items["item_id"]) & (lines["item_id_text"] == items["item_id_text"])).select(lines["doc_id"], lines["doc_id_text"], lines["item_id"], "shift", "item_words")
    both = both.join(h, both["doc_id"].eqNullSafe(h["doc_id"]) & (both["doc_id_text"] == h["doc_id_text"])).select(both["doc_id"], "item_id", "shift", "item_words", "words")
    equal = "transform(sequence(greatest(0, -shift), least(size(item_words), size(words) - shift) - 1), k -> get(words, k + shift) = get(item_words, k))"
    best = f"""aggregate({equal}, struct(0 AS here, 0 AS best),
        (x, same) -> struct(greatest(x.here + IF(same, 1, -1), 0) AS here, greatest(x.best, x.here + IF(same, 1, -1)) AS best),
        x -> CAST(x.best AS BIGINT))"""
    scored = both.select("doc_id", "item_id", F.expr(best).alias("score"), F.least(F.lit(LEAST_SCORE), F.size("item_words")).alias("least")).where("score >= least")
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that hold no benchmark item, with all their columns."""
    # written, so that Spark knows the size when it chooses the join
    found = written(contaminated_pairs(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_found")).distinct(), "found")
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_found"]), "left_anti")


def _sql() -> str:
    normal = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \x09-\x0D]+'), lambda w: w <> '')"
    masks = [(i, m, "true") for i, m in enumerate(MASKS)] + [(len(MASKS) + n, "1" * n, f"{n} IN (LENGTHS)") for n in range(1, LEAST_SCORE)]
    seeds = lambda table, lengths: " UNION ALL ".join(
        f"SELECT r, CAST(place AS BIGINT) AS place, '{i}:' || " + " || ' ' || ".join(f"words[place + {k + 1}]" for k, c in enumerate(m) if c == "1")
        + f" AS seed FROM (SELECT *, unnest(range(greatest(len(words) - {len(m) - 1}, 0))) AS place FROM {table} WHERE {where.replace('LENGTHS', lengths)})"
        for i, m, where in masks
    )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id AS id, {normal} AS words FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS r, item_id AS id, {normal} AS words FROM benchmark),
ds AS ({seeds("d", "SELECT len(words) FROM b")}),
bs AS ({seeds("b", "len(words)")}),
lines AS (SELECT row_number() OVER () AS line, * FROM (SELECT DISTINCT ds.r AS dr, bs.r AS br, ds.place - bs.place AS shift FROM ds JOIN bs USING (seed))),
steps AS (
  SELECT line, d.id AS doc_id, b.id AS item_id, least({LEAST_SCORE}, len(b.words)) AS needed, k, CASE WHEN d.words[k + shift + 1] = b.words[k + 1] THEN 1 ELSE -1 END AS step
  FROM lines JOIN d ON d.r = dr JOIN b ON b.r = br, LATERAL (SELECT unnest(range(greatest(0, -shift), least(len(b.words), len(d.words) - shift))) AS k) x),
sums AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY k) AS total FROM steps),
lows AS (SELECT *, total - least(0, coalesce(min(total) OVER (PARTITION BY line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM sums)
SELECT doc_id, item_id, CAST(max(score) AS BIGINT) AS score FROM lows WHERE score >= needed GROUP BY doc_id, item_id
"""


ORACLE_SQL = _sql()
