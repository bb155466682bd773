"""Phrase collocations: contiguous word runs counted per language, scored at their weakest cut.

Texts are lower-cased in A-Z and split at `[.,;:!?]` and U+000A-000D into pieces, these at spaces and tabs into words. Each
task writes its texts once as chunks: a row of one language with its distinct words, their hashes, and all its words as
numbers, where 0 parts pieces. Further passes read chunks only.

A run can only reach `least` if the runs in it do. So level by level, from words to runs of `max_n - 1`, chunks add up the
occurrences of a run's 64-bit hash, where both runs one word shorter are in the level's filter before, and Spark sums them;
the hashes that reach `least` make the next filter, a Bloom filter of bounded size. Hashes that meet, and a filter's false
finds, only let more runs through. The last pass counts the runs that are left by their words, not by hashes, and what has
less than `least` goes then; so no result rests on a hash or on a filter.

A phrase of two or more words found `least` times is a candidate. Each cut of it into two parts gives
floor(2000000 * a / (l + r)) in decimals, and the lowest one counts, the first on ties. A candidate goes if a run longer by
one word holds it and has at least `share` percent of its count; a longer run yet that has them implies one by one word.

Defined results: a null text is empty, a null language is `und`; texts without words give nothing; repeated rows count
each time; other columns are ignored; empty tables give no rows. A worker holds one chunk, of a step of text or one longer
text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_steps, mix, packed, release, removed, unpacked, written
from .segments import _LOWER, binary, content

#: The filter has eight to sixteen bits for a run, between these numbers of 64-bit words (32 KB and 64 MB).
FILTER_WORDS = (1 << 12, 1 << 23)
#: Bytes of text from which a task writes out the chunks it has gathered; rows of one batch of phrases.
CHUNK_BYTES, ROWS = 16 << 20, 100_000
#: Phrases of several chunks that a task holds to add them up before they are shuffled.
HELD_ROWS = 1 << 20


#: Characters but those that lower-casing is known not to change, beside ASCII's own.
_OTHERS = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Nd}\p{Zs}\p{Sc}]"


def _ascii_lower(c: Column) -> Column:
    """A-Z to a-z; only texts with other capitals, or unknown characters, take the slow way."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when((F.octet_length(c) != F.char_length(c)) & c.rlike(_OTHERS), F.translate(c, capitals, capitals.lower())).otherwise(F.lower(c))


# Chunks

_CHUNK = "lang string, n long, ends binary, words binary, hashes binary, stream binary"
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


def numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts as numbers from 1, with a 0 before each piece that has any, and the distinct words."""
    raw, at = content(texts)
    kind = _KIND[raw]
    solid = kind == 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = at[:-1][at[1:] > at[:-1]]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.int32), pa.array([], pa.large_binary())
    parted = kind == 2
    parted[begins] = True
    before = np.cumsum(parted, dtype=np.int32)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = before[1:] > before[:-1]
    edges = np.append((np.cumsum(solid, dtype=np.int32) - 1)[starts], int(solid.sum()))
    coded = pc.dictionary_encode(binary(_LOWER[raw[solid]], edges))
    place = np.arange(len(starts)) + np.cumsum(new)
    stream = np.zeros(place[-1] + 1, np.int32)
    stream[place] = coded.indices.to_numpy(zero_copy_only=False) + 1
    return stream, coded.dictionary


def _chunk_row(lang: str, parts: list[tuple[np.ndarray, pa.Array]]) -> pa.RecordBatch:
    coded = pc.dictionary_encode(pa.concat_arrays([d for _, d in parts]))
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    ends = np.cumsum([len(d) for _, d in parts])
    stream = np.concatenate([np.append(np.int32(0), numbers[e - len(d) : e])[x] for (x, d), e in zip(parts, ends.tolist(), strict=True)])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    raw, at = content(coded.dictionary)
    row = [packed(np.diff(at).astype(np.uint32)), packed(raw), hashes.tobytes(), packed(stream.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int((stream > 0).sum())], pa.int64()), *[pa.array([x], pa.binary()) for x in row]], names=[x.split()[0] for x in _CHUNK.split(", ")])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _CHUNK from lang and text."""
    held, found = 0, defaultdict(list)
    for part, texts in arrow_steps(batches):
        langs = pc.dictionary_encode(part.column("lang"))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            stream, words = numbered(texts.filter(pc.equal(langs.indices, i)))
            if len(stream):
                found[lang].append((stream, words))
        held += len(content(texts)[0])
        if held >= CHUNK_BYTES:
            yield from (_chunk_row(*x) for x in found.items())
            held, found = 0, defaultdict(list)
    yield from (_chunk_row(*x) for x in found.items())
    release()


class Chunk:
    """A chunk's words, and where its runs lie that pass the filters of the levels below."""

    def __init__(self, row: dict):
        self.lang = row["lang"]
        self.words = binary(unpacked(row["words"], np.uint8), np.append(0, np.cumsum(unpacked(row["ends"], np.uint32), dtype=np.int64)))
        self.hashes = np.append(np.uint64(0), np.frombuffer(row["hashes"], np.uint64))
        self.stream = unpacked(row["stream"], np.uint32).astype(np.int32)
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(self.lang.encode()))

    def seeds(self, at: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of the language and the `n` words from each place."""
        out = np.full(len(at), self.seed)
        for i in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.stream[at + i]])
        return out

    def levels(self, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level the places of its runs whose shorter runs pass, and those of them that pass the level's own filter, while there is one."""
        at = np.flatnonzero(self.stream > 0)
        for n in range(1, len(filters) + 2):
            if n > len(filters):
                yield at, at
                return
            if n == 1:
                known = np.append(False, passes(self.word_seeds(), filters[0]))
                good = at[known[self.stream[at]]]
            else:
                good = at[passes(self.seeds(at, n), filters[n - 1])]
            yield at, good
            # a longer run starts where two of these stand beside each other
            at = good[:-1][good[1:] == good[:-1] + 1]

    def word_seeds(self) -> np.ndarray:
        return mix(np.full(len(self.hashes) - 1, self.seed) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:])

    def seed_counts(self, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the level after the filters', and how often each occurs."""
        if not filters:
            return self.word_seeds(), np.bincount(self.stream, minlength=len(self.hashes))[1:]
        *_, (at, _) = self.levels(filters)
        return np.unique(self.seeds(at, len(filters) + 1), return_counts=True)

    def phrases(self, filters: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """Words, phrases and counts of the runs that pass, told apart by their words' numbers."""
        known = np.zeros(len(self.stream), np.int64)
        for n, (_, at) in enumerate(self.levels(filters), 1):
            key = known[at] * (len(self.words) + 1) + self.stream[at + n - 1]
            _, one, where, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            known[at] = where
            for a in range(0, len(one), ROWS):
                words = [self.words.take(pa.array(self.stream[at[one[a : a + ROWS]] + i] - 1)) for i in range(n)]
                yield n, pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())), counts[a : a + ROWS]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0])
    release()


# Filters

def _probe(shift: int, size: int) -> tuple[str, str]:
    return f"CAST(shiftrightunsigned(seed, {shift}) & {size - 1} AS INT)", f"shiftleft(1L, CAST(shiftrightunsigned(seed, {shift + 24}) & 63 AS INT))"


def passes(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether both of a seed's bits, as of _probe, are set."""
    out, u = np.ones(len(seeds), bool), np.uint64
    for shift in (0, 32):
        out &= (bits[((seeds >> u(shift)) & u(len(bits) - 1)).astype(np.int64)] >> ((seeds >> u(shift + 24)) & u(63))) & u(1) > 0
    return out


def _size(n: int) -> int:
    size = FILTER_WORDS[0]
    while size < FILTER_WORDS[1] and size * 8 < n:
        size *= 2
    return size


def _filter(seeds: DataFrame) -> np.ndarray:
    """64-bit words with two bits of each seed. Its size is bounded, so it may pass through the driver."""
    bits = np.zeros(_size(seeds.count()), np.uint64)
    probes = [seeds.select(F.expr(w).alias("word"), F.expr(b).alias("bit")) for w, b in (_probe(s, len(bits)) for s in (0, 32))]
    used = probes[0].union(probes[1]).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[used.column("word").to_numpy()] = used.column("bits").to_numpy().view(np.uint64)
    return bits


def _seed_counts(filters: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [f.value for f in filters]
        for chunk in _read(batches):
            seeds, counts = chunk.seed_counts(given)
            for a in range(0, len(seeds), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(seeds[a : a + ROWS].view(np.int64)), pa.array(counts[a : a + ROWS].astype(np.int64))], names=["seed", "n"])

    return run


def _added(found: dict[tuple[str, int], list[tuple[pa.Array, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, words, phrase and f, each phrase of several chunks once."""
    for (lang, n), parts in found.items():
        table = pa.table({"phrase": pa.chunked_array([p for p, _ in parts]), "f": pa.chunked_array([pa.array(c.astype(np.int64)) for _, c in parts])})
        if len(parts) > 1:
            table = table.group_by("phrase", use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
        for part in table.to_batches(ROWS):
            arrays = [pa.array([lang] * part.num_rows, pa.string()), pa.array(np.full(part.num_rows, n, np.int32)), part.column("phrase").cast(pa.binary()).view(pa.string()), part.column("f")]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "words", "phrase", "f"])


def _phrases(filters: list, most: int = HELD_ROWS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [f.value for f in filters]
        held, found = 0, defaultdict(list)
        for chunk in _read(batches):
            by_words = defaultdict(list)
            for n, phrases, counts in chunk.phrases(given):
                by_words[n].append((phrases, counts))
                held += len(counts)
            for n, parts in by_words.items():
                found[chunk.lang, n].append((pa.concat_arrays([p for p, _ in parts]), np.concatenate([c for _, c in parts])))
            if held >= most:
                yield from _added(found)
                held, found = 0, defaultdict(list)
        yield from _added(found)

    return run


def counts(docs: DataFrame, max_n: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, f, words) of the runs of up to `max_n` words that are found `least` times."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    chunks = written(docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(_chunks, _CHUNK), "chunks", "uncompressed")
    totals = written(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    filters = []
    for _ in range(1, max_n):
        # each chunk gives a seed once, so nothing is gained by adding up before the shuffle
        seeds = chunks.select("lang", "ends", "words", "hashes", "stream").mapInArrow(_seed_counts(filters), "seed long, n long").repartition("seed")
        frequent = written(seeds.groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("seed"), "seeds")
        filters = [*filters, spark.sparkContext.broadcast(_filter(frequent))]
        removed(frequent)
    found = chunks.select("lang", "ends", "words", "hashes", "stream").mapInArrow(_phrases(filters), "lang string, words int, phrase string, f long")
    known = written(found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "runs")
    removed(chunks)
    for f in filters:
        f.destroy()
    return totals, known.select("lang", "phrase", "f", "words")


def _part(first: Column, count: Column) -> Column:
    """`count` words of a phrase from word `first`, counted from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, share: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    totals, known = counts(docs, max_n, least, text_col, lang_col)
    longer = known.where("words > 1")
    # the runs one word shorter at either end of a longer one, with the greatest count of those that hold them
    ends = F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words") - 1)))
    holders = longer.select("lang", ends.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    left = longer.join(holders, ["lang", "phrase"], "left").where(F.col("above").isNull() | (wide("above") * 100 < wide("f") * share)).select("lang", "phrase", F.col("f").alias("a"), "words")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("CAST(a AS DECIMAL(38,0)) * 2000000 div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # one row for each language


def _sql(max_n: int = 4, least: int = 30, share: int = 80, top: int = 2000) -> str:
    runs = " UNION ALL ".join(f"SELECT lang, {n} AS words, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM pieces" for n in range(1, max_n + 1))
    cut = " UNION ALL ".join(f"SELECT *, {k} AS k, array_to_string(w[:{k}], ' ') AS first, array_to_string(w[{k + 1}:], ' ') AS rest FROM cand WHERE words > {k}" for k in range(1, max_n))
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(w[{i}:{i + n - 1}], ' ') AS phrase, a FROM cand WHERE words >= {i + n - 1} AND words > {n}" for n in range(2, max_n) for i in range(1, max_n - n + 2))
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM texts),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM ({runs}) GROUP BY ALL),
cand AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {least}),
held AS (SELECT lang, phrase, max(a) AS above FROM ({inner}) GROUP BY ALL),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST((CAST(c.a AS HUGEINT) * 2000000) // (l.f + r.f) AS BIGINT) AS score
  FROM ({cut}) c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase
  WHERE h.above IS NULL OR 100 * h.above < {share} * c.a),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored) WHERE pick = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang) USING (lang) WHERE rank <= {top}
"""


ORACLE_SQL = _sql()
