"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; bounds a Python worker's memory.
STEP_BYTES = 4 << 20
#: Entries that a worker's table of distinct words may hold before it starts anew.
VOCAB_ENTRIES = 300_000


class Ids(dict):
    """Numbers keys in the order of their first appearance, so `map(ids.__getitem__, words)` runs in C."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that a text operator reads; any other columns, whatever their names, stay out of it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def arrow_steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts Arrow batches so that the text of each part stays near `limit` bytes (one longer text is a part of its own); null texts are empty."""
    for batch in batches:
        given = batch.column(column)
        texts = pc.fill_null(given.cast(pa.large_binary() if pa.types.is_large_string(given.type) else pa.binary()), b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(texts):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The same with the texts as a list."""
    for part, texts in arrow_steps(batches, column, limit):
        yield part, texts.to_pylist()


def release() -> None:
    """Gives freed memory back to the system: a reused worker shouldn't hold an earlier stage's peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start+1, … of each run, one run after the other."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.repeat(np.asarray(starts, np.int64) - first, sizes) + np.arange(total)


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hashes of the k-word windows over a sequence of mixed word hashes; k is at most 5."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        if n > 0:
            out += hashes[i : i + n] * _ODD[i]
    return mix(out)


def packed(x: np.ndarray) -> bytes:
    """An array's bytes by planes, high bytes apart from low ones, compressed with zstandard."""
    x = np.ascontiguousarray(x)
    x = x.view(f"u{x.dtype.itemsize}")
    planes = np.zeros((x.dtype.itemsize, len(x)), np.uint8)
    top = int(x.max()) if len(x) else 0
    for i, plane in enumerate(planes):
        if top >> (8 * i):  # small numbers' high planes are zeros as they are
            plane[:] = x >> x.dtype.type(8 * i) if i else x
    return zstandard.ZstdCompressor(1).compress(planes)


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    out = planes[0].astype(f"u{len(planes)}")
    for i, plane in enumerate(planes[1:], 1):
        if plane.any():
            out |= plane.astype(out.dtype) << out.dtype.type(8 * i)
    return out.view(kind)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; set to a folder of the working directory if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + os.path.abspath("spark-warehouse/checkpoints")
    return f"{base.rstrip('/')}/weftlink-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "t", codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back: its lineage ends there and no executor's loss undoes it.

    The write's own shuffle files go when it is done, since nothing reads them again.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the folders of tables from `written` that nothing reads any more."""
    for table in tables:
        jvm, paths = table.sparkSession.sparkContext._jvm, {f.rsplit("/", 2)[0] for f in table.inputFiles()}
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, max_documents: int, max_bytes: int) -> tuple[list[bytes], list[int]]:
    """Texts and labels for training: of the rows outside the held-out fold, those of the smallest hashes of their ids.

    At most `max_documents` of them and `max_bytes` of text, none of over an eighth of that; labels other than 0 and 1
    aren't learnt from, the greater of an id's labels holds, and rows of one id count once, by the least hash of a text.
    Sizes are counted before any text goes to the driver.
    """
    chosen = labels.where((remainder("doc_id", folds) != 0) & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    # at most max_documents pairs of numbers: a bounded broadcast
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= max_bytes // 8)
    rows = written(rows.select("doc_id", "label", "text", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")), "sample")
    sizes = rows.groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("x")).select("doc_id", F.xxhash64("doc_id").alias("place"), "x.h", "x.n")
    used, wanted = 0, []
    for r in sorted(sizes.collect(), key=lambda r: (r.place, r.doc_id)):  # at most max_documents
        used += r.n
        if used > max_bytes:
            break
        wanted.append((r.doc_id, r.h))
    spark = docs.sparkSession
    some = spark.createDataFrame(wanted, "doc_id long, h long")
    table = rows.join(F.broadcast(some), ["doc_id", "h"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    removed(rows)
    return [t.encode() for t in table.column("text").to_pylist()], table.column("label").to_pylist()
