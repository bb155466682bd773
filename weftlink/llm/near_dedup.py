"""MinHash near-duplicate detection with HyperMinHash registers.

Documents are sets of 64-bit hashes of five-word shingles. Equal sets form a class, which its smallest doc_id stands for.

1. Sketch. Each shingle is hashed a few times over; a hash picks one of 128 buckets, and the bucket keeps the number of
   leading zeros and ten mantissa bits of its smallest hash in 16 bits. Registers of empty buckets are filled from other
   buckets of the document, in an order fixed for each bucket, before four at a time make a band key.
2. Candidates. Classes that share a band key share a group. The smallest member of each group is compared with all
   others; a group whose members then belong to one component is done, since more links inside it change nothing. In the
   rest, every two members of different components are looked at, in the first band that they share: in small groups by
   their registers, which gives few pairs for verification; in large ones by registers and full sets in place, block
   against block, so that no large group is gathered in one place and only links leave the block.
3. Verification. The registers' Jaccard estimate, corrected for chance collisions, drops hopeless pairs (for sets of at
   least 64 shingles, at four standard errors below the threshold); the full sets decide the others.

What may be lost: a link at the threshold itself shares no band with a chance of (1 - 0.75**4)**32, 5 in a million, and is
dropped by its estimate with that of at most 75 of 128 equal registers at 0.75 each, 16 in a million; both fall fast above it.
4. Components by alternating large-star and small-star steps, written to the shared folder after each.

Defined results: a text without words has no shingles and is alone; one with fewer than five words is one shingle; a null
text counts as empty; exact copies and repeated rows are in one class; a null id is no component's name (a class of null
ids alone has the component null and is kept); classes of the same smallest id count as one; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, id_and_text, mix, release, shingles, steps, written

BUCKETS, BANDS, MANTISSA, REPLICAS = 128, 32, 10, 4
_SALTS = mix(np.arange(1, REPLICAS + 1, dtype=np.uint64))
_BAND_SALTS = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
_ORDERS = np.array([np.argsort(mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(1 << 20) * np.uint64(i + 1))) for i in range(BUCKETS)])
#: From here on, inner names of classes whose ids are all null.
_NULL = 1 << 62


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75
    #: Sets below this size are never judged by the estimate.
    estimate_from: int = 64
    estimate_margin: float = 0.16
    #: Groups of more members are compared block by block; members and bytes of sets in a block.
    small_group: int = 64
    block_members: int = 2048
    block_bytes: int = 24 << 20


def shingle_set(words: list[bytes], k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; shorter texts are one shingle, empty ones none."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return _set(h, k)


def _set(h: np.ndarray, k: int) -> np.ndarray:
    if not len(h):
        return h
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    return np.unique(shingles(mix(h), k))


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Shingle sets of the texts of each batch, ASCII letters lower-cased; each distinct word is hashed once a step."""
    for part, texts in steps(batches):
        ids, lists = Ids(), []
        for text in texts:
            words = text.lower().split()
            lists.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
        yield part, [_set(hashes[x], k) for x in lists]
        del ids, lists, hashes, texts
    release()


def registers(shingle_hashes: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: leading zeros and mantissa of each bucket's smallest hash, plus one; 0 if it has none."""
    x = mix((shingle_hashes[:, None] ^ _SALTS[None, :]).ravel())
    least = np.full(BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, (x >> np.uint64(57)).astype(np.int64), x << np.uint64(7))
    m, e = np.frexp(least.astype(np.float64))
    value = (np.minimum(64 - np.minimum(e, 64), 62).astype(np.int64) << MANTISSA) | ((2 * m - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.int64)
    value[least == np.uint64(0xFFFFFFFFFFFFFFFF)] = -1
    return (value + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of four registers, empty ones filled first."""
    empty = np.flatnonzero(regs == 0)
    if len(empty):
        donors = _ORDERS[empty]
        regs = regs.copy()
        regs[empty] = regs[donors[np.arange(len(empty)), (regs[donors] != 0).argmax(axis=1)]]
    return mix(np.ascontiguousarray(regs).view(np.uint64) + _BAND_SALTS).view(np.int64)


def expected_collisions(n1: int, n2: int) -> float:
    """Registers that agree by chance between two disjoint sets of these sizes."""
    octave = 2.0 ** -np.arange(1, 60)
    p1, p2 = (np.exp(-n * REPLICAS / BUCKETS * octave) - np.exp(-n * REPLICAS / BUCKETS * 2 * octave) for n in (n1, n2))
    return float(BUCKETS * (p1 * p2).sum() / (1 << MANTISSA))


def estimate(r1: np.ndarray, r2: np.ndarray, n1: int, n2: int) -> float:
    """Jaccard estimate from two register arrays, corrected for chance collisions."""
    either = int(((r1 != 0) | (r2 != 0)).sum())
    return max(0.0, (int(((r1 == r2) & (r1 != 0)).sum()) - expected_collisions(n1, n2)) / either) if either else 0.0


_SKETCH = "doc_id long, t long, n long, d1 long, d2 long, regs binary"


def _sketch(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in sets_of(batches, s.words):
            digests = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
            split = np.array([[d >> 64, d & 0xFFFFFFFFFFFFFFFF] for d in digests], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("t"), pa.array([len(x) for x in sets], pa.int64()), pa.array(split[:, 0]), pa.array(split[:, 1]), pa.array([registers(x).tobytes() if len(x) else b"" for x in sets], pa.binary())],
                names=["doc_id", "t", "n", "d1", "d2", "regs"],
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column("regs").to_pylist()]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS))], names=["key", "rep"])


def _full_sets(s: Settings):
    """The shingle sets of candidate classes, from texts; rows of another text under the same id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in sets_of(batches, s.words):
            keep, blobs = [], []
            for i, (x, a, b) in enumerate(zip(sets, part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True)):
                d = xxhash.xxh3_128_intdigest(x.tobytes())
                if np.array([d >> 64, d & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64).tolist() == [a, b]:
                    keep.append(i)
                    blobs.append(x.tobytes())
            del sets
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(keep, pa.int64())), part.column("regs").take(pa.array(keep, pa.int64())), pa.array(blobs, pa.binary())], names=["rep", "regs", "whole"])

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("whole_a", "whole_b"))
                if min(len(x), len(y)) >= s.estimate_from:
                    r1, r2 = (np.frombuffer(batch.column(c)[i].as_py(), np.uint16) for c in ("regs_a", "regs_b"))
                    if estimate(r1, r2, len(x), len(y)) < s.percent / 100 - s.estimate_margin:
                        continue
                if linked(x, y, s.percent):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])
        release()

    return run


def _likely(key: int, keys: np.ndarray, regs: np.ndarray, n: np.ndarray, labels: np.ndarray, first: np.ndarray, second: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the members `first` against `second`: pairs of different labels that meet here first and may be similar enough.

    Gives both members and the share of equal registers, for one pair of members once.
    """
    out = []
    for start in range(0, len(first), 32):
        rows = first[start : start + 32]
        a, b = (x.ravel() for x in np.meshgrid(rows, second, indexing="ij"))
        fits = (a != b) & (labels[a] != labels[b]) & (100 * np.minimum(n[a], n[b]) >= s.percent * np.maximum(n[a], n[b]))
        a, b = a[fits], b[fits]
        same = keys[a] == keys[b]
        here = keys[a, same.argmax(axis=1)] == key
        a, b = a[here], b[here]
        there = (regs[a] != 0) | (regs[b] != 0)
        agree = ((regs[a] == regs[b]) & there).sum(axis=1)
        share = agree / np.maximum(1, there.sum(axis=1))
        # collisions by chance are fewer than one register, which this leaves room for
        near = (share >= s.percent / 100 - s.estimate_margin) | (np.minimum(n[a], n[b]) < s.estimate_from)
        out.append((a[near], b[near], share[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def _members(rows: list[dict]) -> tuple[np.ndarray, ...]:
    regs = np.array([np.frombuffer(r["regs"], np.uint16) for r in rows])
    return np.array([band_keys(x) for x in regs]), regs, np.array([r["n"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), np.array([r["rep"] for r in rows], np.int64)


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[dict]]:
    """Runs of rows that agree in the columns; the input is sorted by them."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = tuple(row[c] for c in columns)
            if rows and at != now:
                yield rows
                rows = []
            now = at
            rows.append(row)
    if rows:
        yield rows


def _near_pairs(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "key"):
            keys, regs, n, labels, reps = _members(rows)
            every = np.arange(len(rows))
            a, b, _ = _likely(rows[0]["key"], keys, regs, n, labels, every, every, s)
            once = reps[a] < reps[b]
            yield pa.RecordBatch.from_arrays([pa.array(reps[a][once]), pa.array(reps[b][once])], names=["a", "b"])
        release()

    return run


def _dense_links(s: Settings):
    """Links inside one block, or between two: most similar pairs first, none within what is linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "key", "i", "j"):
            keys, regs, n, labels, reps = _members(rows)
            block = np.array([r["block"] for r in rows])
            first, second = np.flatnonzero(block == rows[0]["i"]), np.flatnonzero(block == rows[0]["j"])
            a, b, share = _likely(rows[0]["key"], keys, regs, n, labels, first, second, s)
            sets, root, found = [np.frombuffer(r["whole"], np.uint64) for r in rows], {}, []

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:  # noqa: B023
                    root[x] = x = root.get(up, up)  # noqa: B023
                return x

            for k in np.argsort(-share, kind="stable"):
                i, j = int(a[k]), int(b[k])
                x, y = find(int(labels[i])), find(int(labels[j]))
                if x != y and linked(sets[i], sets[j], s.percent):
                    root[x] = y
                    found.append((int(reps[i]), int(reps[j])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        release()

    return run


def _large_groups(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links between members of different labels in groups of any size, block against block."""
    whole = sets.select("rep", "regs", "whole", (F.octet_length("whole") / 8).cast("long").alias("n"))
    sized = members.join(whole.select("rep", "n"), "rep").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / s.block_members), F.ceil(F.sum("n") * 8 / s.block_bytes)).cast("int").alias("blocks"))
    placed = members.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.select("key", "rep", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "rep", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(whole, "rep")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_dense_links(s), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("whole").alias(f"whole_{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "regs_a", "regs_b", "whole_a", "whole_b").mapInArrow(_confirm(s), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the label is the component's smallest node."""

    def state(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(edges: DataFrame, small: bool) -> DataFrame:
        """Edges (u, v): each node's neighbours (smaller ones only in a small star) now hang on the smallest of them."""
        if small:
            around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        else:
            around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if small:
            moved = around.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "links")
    before = state(edges)
    while True:
        edges = written(star(star(edges, small=False), small=True), "links")
        after = state(edges)
        if after == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        before = after


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _labelled(docs, s, id_col, text_col).drop("t")


def _labelled(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """The same with t, a hash of the text."""
    named = id_and_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))
    checked = F.when(F.col("doc_id") >= _NULL, F.raise_error(F.lit("near_duplicates: ids must be below 2**62"))).otherwise(F.col("doc_id"))
    sketches = written(named.withColumn("doc_id", checked).mapInArrow(_sketch(s), _SKETCH), "sketches")
    # a class has its least real id; null ones sort last by this stand-in
    inner = F.coalesce("doc_id", F.lit(_NULL) + F.shiftrightunsigned("d1", 2))
    least = F.min(F.struct(inner.alias("rep"), "t", "n", "regs")).alias("x")
    classes = written(sketches.where("n > 0").groupBy("d1", "d2").agg(least).select("d1", "d2", "x.rep", "x.t", "x.n", "x.regs"), "classes")
    bands = classes.select("rep", "regs").mapInArrow(_bands, "key long, rep long")
    shared = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("pivot")).where("c > 1")
    members = written(bands.join(shared, "key"), "members")
    wanted = members.select("rep").distinct().join(classes.select("rep", "t", "d1", "d2", "regs"), "rep")
    texts = _texts(named, wanted)
    sets = written(texts.mapInArrow(_full_sets(s), "rep long, regs binary, whole binary"), "sets")

    pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(confirmed(pairs, sets, s), "confirmed")
    labels = components(links)
    labelled = members.where("c > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"), "c")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    still_open = written(labelled.join(mixed, "key"), "open")
    small = still_open.where(F.col("c") <= s.small_group).join(sets.select("rep", "regs", (F.octet_length("whole") / 8).cast("long").alias("n")), "rep")
    pairs = small.select("key", "rep", "label", "n", "regs").repartition("key").sortWithinPartitions("key").mapInArrow(_near_pairs(s), "a long, b long").distinct()
    found = confirmed(pairs, sets, s).union(_large_groups(still_open.where(F.col("c") > s.small_group), sets, s))
    found = written(found, "confirmed")
    if not found.isEmpty():
        labels = components(links.union(found))
    named_classes = classes.select("d1", "d2", "rep", F.col("t").alias("first_t")).join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    out = sketches.select("doc_id", "t", "n", "d1", "d2").join(named_classes, ["d1", "d2"], "left")
    component, mine = F.col("component"), F.col("doc_id")
    named_one = F.when(component.isNull(), mine).when(component < _NULL, component)
    kept = F.when(component.isNull(), True).when(component < _NULL, F.coalesce(component == mine, F.lit(False))).otherwise((component == F.col("rep")) & (F.col("t") == F.col("first_t")))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), named_one.alias("component_id"), kept.alias("kept"))


def _texts(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of candidate classes: by id and text hash, and for classes without an id by text hash alone."""
    real = named.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text", "t").join(wanted.where(F.col("rep") < _NULL), ["rep", "t"])
    lone = named.where("doc_id is null").select("text", "t").dropDuplicates(["t"]).join(wanted.where(F.col("rep") >= _NULL), "t")
    return real.drop("t").unionByName(lone.drop("t"))


def deduplicated(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each component, with all columns: that of its smallest id. Rows of one id and text are one."""
    key, text = "_key", "_text"
    while {key, text} & {*docs.columns}:
        key, text = key + "_", text + "_"
    keep = _labelled(docs, s, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept"), "t").distinct()
    own = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(text, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return own.join(keep, own[key].eqNullSafe(keep["_kept"]) & (own[text] == keep["t"]), "left_semi").dropDuplicates([key, text]).drop(key, text)
