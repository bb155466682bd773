"""Token ids in files of shards, each compressed by a Re-Pair grammar.

Documents are dealt by range of doc_id over parts and encoded with a public tokeniser in ascending order; every document
ends with the id 0. A part is written as shards, one after the other; a shard holds whole documents, about `shard_ids`
ids, and has one grammar: frequent pairs of neighbours are replaced by nonterminals, again and again, until no pair is
frequent. The files are Parquet, so any store that Spark writes to will do; one row is one shard:

    part, shard    its place; shards of a part, and parts, are in the order of doc_id
    first          ids of the part before the shard
    doc_ids        the documents' ids (a list, null ids allowed)
    lengths        ids of each document
    base           ids below it are the tokeniser's; base + i is the i-th rule
    left, right    the rules' two symbols, little-endian unsigned 32-bit
    sizes          the rules' expansion lengths, likewise
    symbols        the compressed sequence, likewise

Expansion lengths give the place of any id without decoding what stands before it: read_documents decodes the wanted
documents' ranges alone.

Each distinct segment of text (see segments) is encoded once by a worker; the ids are those of whole texts.

Defined results: a null text counts as empty and has the end id alone; null ids come first; rows of one id are ordered by
a hash of their texts, and repeated rows are all kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_steps, id_and_text, ragged, shared_dir
from .segments import Known, begin_in_space, content, cut

END = 0
#: Segments that a worker remembers, and their bytes, before it starts anew.
KNOWN_SEGMENTS, KNOWN_BYTES = 1_000_000, 64 << 20


@dataclass(frozen=True)
class Settings:
    shard_ids: int = 1 << 20
    #: A pair becomes a rule only if it stands at least so often in its shard.
    least_pairs: int = 8


FILE_SCHEMA = "part int, shard int, first long, n_ids long, doc_ids array<long>, lengths binary, base int, left binary, right binary, sizes binary, symbols binary"


class Encoder:
    """Texts to ids. The ids of each distinct segment stay in flat arrays until there are too many."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # a byte-level token's string has one character for each byte
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(self.special[i].encode()) if i in self.special else len(token)
        self.special = tuple(self.special.values())
        self.clear()

    def clear(self) -> None:
        self.known, self.sizes, self.starts, self.flat = Known(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def _joined(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for segments that begin with white space and don't end in it: a thousand in one call, told apart by their bytes."""
        raw, at = content(segments)
        edges = at[np.append(np.arange(0, len(segments), 1000), len(segments))].tolist()
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)])
        ends = np.cumsum(self.bytes_of[flat])
        last = np.searchsorted(ends, at[1:])
        if not len(ends) or ends[-1] != at[-1] or (ends[last] != at[1:]).any():
            return self._each([s.decode("utf-8", "replace") for s in segments.to_pylist()])
        return np.diff(last, prepend=-1), flat

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each segment, and all ids."""
        plain = begin_in_space(new)
        every = content(new)[0].tobytes()
        if any(x.encode() in every for x in self.special):
            plain &= [not any(x.encode() in s for x in self.special) for s in new.to_pylist()]
        parts = []
        if plain.any():
            parts.append(self._joined(new.filter(pa.array(plain))))
        if not plain.all():
            parts.append(self._each([s.decode("utf-8", "replace") for s in new.filter(pa.array(~plain)).to_pylist()]))
        sizes, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.cumsum(sizes) - sizes
        back = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        return sizes[back], flat[ragged(starts[back], sizes[back])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end id, and the number of ids of each."""
        if len(self.known) > KNOWN_SEGMENTS or self.known.values.nbytes > KNOWN_BYTES:
            self.clear()
        segments, counts = cut(texts)
        numbers, new = self.known.number(segments)
        if len(new):
            sizes, flat = self._learn(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        sizes = self.sizes[numbers]
        lengths = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))])
        return np.insert(self.flat[ragged(self.starts[numbers], sizes)], np.cumsum(lengths), END), lengths + 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for each Python worker; tasks that follow find the segments of earlier ones."""
    return Encoder(path)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 20


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(44)).astype(np.int64)


def _frequent(keys: np.ndarray, limit: int) -> np.ndarray:
    """Sorted distinct keys that occur at least `limit` times."""
    ordered = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    return ordered[edge[np.diff(np.append(edge, len(ordered))) >= limit]]


def _rules_of(keys: np.ndarray, slots: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each key's place among the pairs, or -1: through a table of slots, by search where two pairs share a slot."""
    table = np.full(_SLOTS, -1, np.int64)
    own = _slot(pairs)
    table[own] = np.arange(len(pairs))
    rule = table[slots]
    wrong = np.flatnonzero((rule >= 0) & (pairs[rule] != keys))
    if len(wrong):
        found = np.minimum(np.searchsorted(pairs, keys[wrong]), len(pairs) - 1)
        rule[wrong] = np.where(pairs[found] == keys[wrong], found, -1)
    return rule


def compress(ids: np.ndarray, base: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and the rules' left and right sides; ends when no pair occurs `least` times.

    Each round takes all pairs of over a quarter of the greatest count. Once the least count is reached, only pairs with
    a nonterminal of the round before are counted, as no other's count can have grown.
    """
    seq, left, right = ids.astype(np.uint64), [], []
    made, limit, fresh = 0, None, None
    while len(seq) > 1:
        if fresh is None:
            keys = (seq[:-1] << np.uint64(32)) | seq[1:]
            slots = _slot(keys)
            held = np.bincount(slots, minlength=_SLOTS)  # no less than any pair's count
            most = int(held.max())
            if most < least:
                break
            limit = max(least, most // 4) if limit is None else max(least, min(limit // 4, most))
            at = np.flatnonzero(held[slots] >= limit)
            near, slots = keys[at], slots[at]
        else:
            at = np.sort(np.concatenate([fresh - 1, fresh]))
            at = at[(np.diff(at, prepend=-2) > 0) & (at >= 0) & (at + 1 < len(seq))]
            near = (seq[at] << np.uint64(32)) | seq[at + 1]
            slots = _slot(near)
        pairs = _frequent(near, limit)
        if not len(pairs):
            if limit == least:
                break
            continue
        rule = _rules_of(near, slots, pairs)
        known = rule >= 0
        at, rule = at[known], rule[known]
        # overlapping pairs: every other one of a run, from the left
        place = np.arange(len(at))
        start = np.concatenate([[True], np.diff(at) > 1])
        odd = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 1
        at, rule = at[~odd], rule[~odd]
        used = np.bincount(rule, minlength=len(pairs)) > 0
        pairs, number = pairs[used], np.cumsum(used) - 1
        left.append((pairs >> np.uint64(32)).astype(np.uint32))
        right.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        seq[at] = (base + made + number[rule]).astype(np.uint64)
        made += len(pairs)
        seq = np.delete(seq, at + 1)
        # with every pair of the least count replaced, but for those that overlapped another, which stand by a new symbol
        fresh = at - np.arange(len(at)) if limit == least else None
    empty = [np.empty(0, np.uint32)]
    return seq.astype(np.uint32), np.concatenate(left or empty), np.concatenate(right or empty)


def rule_sizes(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Expansion lengths; a rule's sides come before it."""
    sizes = [1] * len(left)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        sizes[i] = (sizes[a - base] if a >= base else 1) + (sizes[b - base] if b >= base else 1)
    return np.array(sizes, np.uint32)


def _expansions(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' expansions, one after the other, and where each starts."""
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        at = int(starts[i])
        for side in (a, b):
            if side < base:
                out[at] = side
                at += 1
            else:
                n, s = int(sizes[side - base]), int(starts[side - base])
                out[at : at + n] = out[s : s + n]
                at += n
    return out, starts


def decode(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """All ids of a shard."""
    text, starts = _expansions(left, right, sizes, base)
    pool = np.concatenate([text, symbols])
    big = symbols >= base
    rule = np.where(big, symbols, base).astype(np.int64) - base
    start = np.where(big, starts[rule] if len(starts) else 0, len(text) + np.arange(len(symbols)))
    return pool[ragged(start, np.where(big, sizes[rule] if len(sizes) else 1, 1))]


def decode_range(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """The ids [start, stop) of a shard; only symbols that reach into the range are expanded."""
    big = symbols >= base
    ends = np.cumsum(np.where(big, sizes[np.where(big, symbols, base).astype(np.int64) - base] if len(sizes) else 1, 1), dtype=np.int64)
    a = int(np.searchsorted(ends, start, side="right"))
    at, out = int(ends[a - 1]) if a else 0, []
    for symbol in symbols[a:].tolist():
        if at >= stop:
            break
        stack = [symbol]
        while stack:
            x = stack.pop()
            if x < base:
                if start <= at < stop:
                    out.append(x)
                at += 1
            elif at + int(sizes[x - base]) <= start:
                at += int(sizes[x - base])
            else:
                stack += [int(right[x - base]), int(left[x - base])]
    return np.array(out, np.uint32)


def _write(path: str, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part_number = _encoder(path), TaskContext.get().partitionId()
        docs, lists, held, shard, first = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            symbols, left, right = compress(np.concatenate(lists), encoder.size, s.least_pairs)
            binary = [x.astype("<u4").tobytes() for x in (left, right, rule_sizes(left, right, encoder.size), symbols)]
            row = {"part": pa.array([part_number], pa.int32()), "shard": pa.array([shard], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([held], pa.int64())}
            row |= {"doc_ids": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([np.array([len(x) for x in lists], "<u4").tobytes()], pa.binary()), "base": pa.array([encoder.size], pa.int32())}
            row |= dict(zip(("left", "right", "sizes", "symbols"), (pa.array([b], pa.binary()) for b in binary), strict=True))
            return pa.RecordBatch.from_pydict(row)

        for part, texts in arrow_steps(batches):
            flat, lengths = encoder.encode(texts)
            for doc, ids in zip(part.column("doc_id").to_pylist(), np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
                if lists and held + len(ids) > s.shard_ids:
                    yield flush()
                    shard, first = shard + 1, first + held
                    docs, lists, held = [], [], 0
                docs.append(doc)
                lists.append(ids)
                held += len(ids)
        if lists:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, shards: int | None = None, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents' ids below `path`. One shuffle, by range of doc_id."""
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = id_and_text(docs, id_col, text_col).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_write(tokenizer_path, s), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _arrays(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(x)[i].as_py(), "<u4") for x in names]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            symbols, left, right, sizes, lengths = _arrays(batch, i, "symbols", "left", "right", "sizes", "lengths")
            ids = decode(symbols, left, right, sizes, batch.column("base")[i].as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            raw = memoryview(ids.astype("<u4").tobytes())
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_ids")[i].values,
                    pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)),
                    pa.array(starts + batch.column("first")[i].as_py()),
                    pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ],
                names=["doc_id", "part", "place", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = files.drop("shard", "n_ids").mapInArrow(_read, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def _pick(wanted: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("doc_ids")[i].as_py()
                symbols, left, right, sizes, lengths = _arrays(batch, i, "symbols", "left", "right", "sizes", "lengths")
                ends, base = np.cumsum(lengths, dtype=np.int64), batch.column("base")[i].as_py()
                own = [k for k, doc in enumerate(docs) if doc in wanted]
                ids = [decode_range(symbols, left, right, sizes, base, int(ends[k] - lengths[k]), int(ends[k])).astype(np.int64) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([docs[k] for k in own], pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """doc_id and ids (with the end id) of a few documents: shards without one are skipped, of others only their ranges are decoded."""
    wanted = sorted(set(doc_ids))
    files = spark.read.schema(FILE_SCHEMA).parquet(path).where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted)).cast("array<long>")))
    return files.select("doc_ids", "lengths", "base", "left", "right", "sizes", "symbols").mapInArrow(_pick(frozenset(wanted)), "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes to the shared folder and reads back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens"
    write_tokens(docs, tokenizer_path, path)
    return read_tokens(docs.sparkSession, path)
