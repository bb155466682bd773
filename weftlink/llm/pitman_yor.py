"""Language-model scores from a hierarchical Pitman-Yor model, sampled by Gibbs in Chinese-restaurant seatings.

Three levels share dishes (words): the root restaurant; below it one restaurant for each class of words before, a class
being the words of one ending (their last two bytes); below each of these one restaurant for each word before. So a word
that its context has never served is served by what words of that ending serve, and then by the whole corpus. A
restaurant's new tables are customers of its parent; the root's parent is the base measure, which gives a share to the
unknown word and spreads the rest evenly over the known ones. Contexts, classes' dishes and words all grow with the corpus.

How it is spread out:

1. Each task cuts its documents into chunks. A chunk is one row: its tokens as numbers of its distinct words, and these
   words' hashes and endings.
2. Pairs (word before, word) are dealt to shards by class; a class of more than `shard_tokens` tokens is dealt to several
   by the following word's hash, so a class's dish is whole in one shard, and no context is treated apart. Chunks send
   each shard their pairs with training counts, which it adds up once. No piece is empty, so pieces are never more than
   pairs.
3. After each sweep, sums that no shard has whole go to owners, by hash, and come back: the root's customers of each word,
   and of each class that is dealt to several shards, and its contexts, customers and tables. Owners seat the root. So
   restaurants are whole however they are dealt: `shard_tokens` bounds memory and changes no result.
4. A sweep seats everyone anew, level by level: each dish's number of tables is drawn as a whole, with table sizes summed
   out, given the restaurants' tables and the parents' probabilities before the level's draw. The tables are the parent's
   customers. Draws are hashes of the dish and the sweep. Predictive probabilities after the kept sweeps are averaged for
   each pair.
5. Chunks meet the answers to their pairs and add up the logarithms.

Discounts are estimated from the corpus, as n1 / (n1 + 2 n2) of each level's dishes with one and with two customers.

Tokens: words are maximal runs of characters other than space and U+0009-000D, ASCII letters lower-cased, and one end
after the last. Word hashes have 64 bits. What one shard or chunk holds is bounded by settings (one longer text is a
chunk of its own). The driver's plan has one entry for each of 65,536 endings.

Defined results: a null text counts as empty and is the end alone; a null id is in the held-out part (crc32 of the empty
text is 0); repeated rows count as often as they stand; other columns are ignored; an empty table gives no rows; without
training tokens the base measure scores everything.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_steps, id_and_text, mix, packed, ragged, release, removed, unpacked, written
from .segments import Known, content, words

#: Customers of a dish up to which its number of tables is drawn from exact weights; weights in memory at once, about;
#: nodes of the others' weights; tables up to which each has its weight instead; terms of the series.
EXACT, DRAWN, NODES, FEW, TERMS = 1024, 1 << 19, 65, 64, 80
#: Customers up to which all dishes of one number are drawn together, and the weight up to which its powers stay finite.
SMALL, LARGE_WEIGHT = 32, 1e9
#: The end's hash, and the hash of the context of a text's first token.
END, START = 1, 0
#: Answers are decimal logarithms in steps of one in so many.
FIXED = float(1 << 18)
#: Shards for each owner of sums.
SHARDS_OF_OWNER = 8


@dataclass(frozen=True)
class Settings:
    folds: int = 10
    chunk_bytes: int = 16 << 20
    #: Training tokens in a shard, about.
    shard_tokens: int = 3 << 19
    #: Sweeps with the given discounts; then with the corpus's.
    own_sweeps: int = 2
    burn_in: int = 2
    kept: int = 3
    #: Discounts of the first sweeps, the root's first; the corpus's own are estimated after these.
    discounts: tuple[float, float, float] = (0.7, 0.8, 0.75)
    strengths: tuple[float, float, float] = (1.0, 5.0, 2.0)
    unknown: float = 0.5
    seed: int = 11


# 1. Chunks

_CHUNK = "chunk long, docs binary, n_tokens binary, held binary, stream binary, words binary, endings binary, sums binary, train_tokens long"


def held_out(doc: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % folds == 0


def endings_of(distinct: pa.Array) -> np.ndarray:
    """Each word's last two bytes as one number, the last one low."""
    raw, at = content(distinct)
    last = raw[at[1:] - 1].astype(np.uint16)
    return last | np.where(np.diff(at) > 1, raw[np.maximum(at[1:] - 2, 0)].astype(np.uint16) << 8, 0).astype(np.uint16)


def chunk_of(docs: list[int | None], found: np.ndarray, sizes: np.ndarray, distinct: pa.Array, folds: int) -> dict[str, np.ndarray]:
    """One chunk's arrays, from its words' numbers, the number of words of each text, and the distinct words. Words get the order of falling frequency, the end the first place."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    # above the end's; two spellings of one hash, should they ever meet, are one word
    hashes, one, place = np.unique(np.maximum(hashes, np.uint64(2)), return_index=True, return_inverse=True)
    found, endings = place[found], endings_of(distinct)[one] if len(distinct) else np.empty(0, np.uint16)
    order = np.argsort(-np.bincount(found, minlength=len(hashes)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    stream = np.insert(rank[found], np.cumsum(sizes), 0)
    held = np.array([held_out(d, folds) for d in docs], bool)
    out = {"n_tokens": (sizes + 1).astype(np.uint32), "held": held, "words": np.append(np.uint64(END), hashes[order]), "endings": np.append(np.uint16(0), endings[order])}
    out["stream"] = stream.astype(np.uint32)
    tokens, before, train = Chunk(out).tokens()
    seen = np.bincount(before[train], minlength=len(out["words"]) + 1)
    sums = np.bincount(np.append(out["endings"], 0), seen, 1 << 16).astype(np.int64)
    rows = np.flatnonzero(sums)
    out["sums"] = np.column_stack([rows, sums[rows]])
    out["train_tokens"] = np.array([train.sum()])
    return out


class Chunk:
    """A chunk's arrays, as made by chunk_of or read from its row."""

    def __init__(self, arrays: dict):
        kinds = {"n_tokens": np.uint32, "held": bool, "stream": np.uint32, "words": np.uint64, "endings": np.uint16}
        sizes, self.held, stream, self.words, self.endings = (unpacked(x, kinds[n]) if isinstance(x := arrays[n], bytes) else x for n in kinds)
        self.stream, self.sizes = stream.astype(np.int64), sizes.astype(np.int64)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's word, its context (the number of words stands for the start), and whether it is for training."""
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = len(self.words)
        return self.stream, before, np.repeat(~self.held, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs' contexts and words, their training counts, and each token's pair."""
        tokens, before, train = self.tokens()
        keys, stream = np.unique(before * len(self.words) + tokens, return_inverse=True)
        context, word = np.divmod(keys, len(self.words))
        return context, word, np.bincount(stream, train, len(keys)).astype(np.uint32), stream

    def dealt(self, plan: Plan) -> tuple[np.ndarray, ...]:
        """The same, with the order of pairs by shard, the shards that get some, and where each one's begin."""
        context, word, counts, stream = self.pairs()
        shard = plan.shards(np.append(self.endings, np.uint16(0))[context], self.words[word])
        order = np.argsort(shard, kind="stable")
        found, starts = np.unique(shard[order], return_index=True)
        return context, word, counts, stream, order, found, np.append(starts, len(order))


def _chunks(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for docs, *text in _large_steps(batches, s.chunk_bytes):
            c = chunk_of(docs, *text, s.folds)
            number += 1
            row = {"chunk": pa.array([number], pa.int64()), "docs": pa.array([_ids(docs).tobytes()], pa.binary())}
            row |= {k: pa.array([v.tobytes() if v.dtype == np.int64 else packed(v)], pa.binary()) for k, v in c.items() if k != "train_tokens"}
            row |= {"train_tokens": pa.array(c["train_tokens"], pa.int64())}
            yield pa.RecordBatch.from_pydict({k: row[k] for k in (x.split()[0] for x in _CHUNK.split(", "))})
        release()

    return run


def _ids(docs: list[int | None]) -> np.ndarray:
    """Pairs of (is null, id)."""
    return np.array([(d is None, d or 0) for d in docs], np.int64).reshape(-1, 2)


def _large_steps(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, pa.Array]]:
    """Ids, word numbers, words of each text and distinct words, gathered over batches until the texts have `limit` bytes."""
    docs, parts, sizes, known, held = [], [], [], Known(), 0

    def gathered():
        return docs, np.concatenate(parts).astype(np.int64), np.concatenate(sizes), known.values

    for part, texts in arrow_steps(batches):
        found, distinct, counts = words(texts)
        docs += part.column("doc_id").to_pylist()
        parts.append(known.number(distinct)[0].astype(np.int32)[found])
        sizes.append(counts)
        held += len(content(texts)[0])
        if held >= limit:
            yield gathered()
            docs, parts, sizes, known, held = [], [], [], Known(), 0
    if docs:
        yield gathered()


# 2. The plan and the pieces


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens after words of each ending, added up within a batch."""
    for batch in batches:
        rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("sums").to_pylist()])
        keys, where = np.unique(rows[:, 0], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(where, rows[:, 1], len(keys)).astype(np.int64))], names=["key", "n"])


@dataclass(frozen=True)
class Plan:
    """Which shard gets a pair: first shard and number of parts of each ending."""

    first: np.ndarray
    parts: np.ndarray
    shards_total: int

    @staticmethod
    def of(endings: dict[int, int], limit: int) -> Plan:
        """From the tokens of each ending."""
        sums = np.zeros(1 << 16, np.int64)
        for e, n in endings.items():
            sums[e] = n
        parts = np.maximum(1, -(-sums // limit))
        # endings of one part share shards as long as these hold less than the limit
        small = np.where(parts == 1, sums, 0)
        shared = np.cumsum(small) // limit
        first = np.where(parts == 1, shared, 0)
        at = int(shared.max()) + 1
        large = np.flatnonzero(parts > 1)
        first[large] = at + np.cumsum(parts[large]) - parts[large]
        return Plan(first, parts, at + int(parts[large].sum()))

    @property
    def owners(self) -> int:
        return -(-self.shards_total // SHARDS_OF_OWNER)

    def shards(self, endings: np.ndarray, following: np.ndarray) -> np.ndarray:
        return self.first[endings] + ((mix(following) >> np.uint64(16)) % self.parts[endings].astype(np.uint64)).astype(np.int64)


#: Rows that go to shards, or from shards to owners; `of` is the chunk of a piece, the owner of sums.
_ROW = "shard long, kind int, of long, parts array<binary>"
PIECE, STATE, ASKED, SUMS = range(4)


def _rows(rows: list[tuple], names: str = _ROW) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    columns = [x.split() for x in names.split(", ")]
    for a in range(0, len(rows), 500):
        values = zip(*rows[a : a + 500], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def _pieces(plan: Plan):
    """Each chunk's part for each shard: contexts with their endings and pairs, distinct words, the pairs' words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                context, word, counts, _, order, found, starts = c.dealt(plan)
                names, endings = np.append(c.words, np.uint64(START)), np.append(c.endings, np.uint16(0))
                rows = []
                for k, a, b in zip(found.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = order[a:b]  # by context, then word
                    of, sizes = _runs(context[own])
                    used, place = np.unique(word[own], return_inverse=True)
                    rows.append((k, PIECE, row["chunk"], _piece(names[of], endings[of], sizes, c.words[used], place, counts[own])))
                yield from _rows(rows)

    return run


def _piece(contexts: np.ndarray, endings: np.ndarray, sizes: np.ndarray, words: np.ndarray, place: np.ndarray, counts: np.ndarray) -> list[bytes]:
    return [packed(x) for x in (contexts, endings, sizes.astype(np.uint32), words, place.astype(np.uint32), counts.astype(np.uint32))]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal ones."""
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[edge], np.diff(np.append(edge, len(x)))


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each given one among them; quick for keys in order, or in a few runs of such."""
    order = None if (keys[1:] >= keys[:-1]).all() else np.argsort(keys, kind="stable")
    ranked = keys if order is None else keys[order]
    edge = np.append(True, ranked[1:] != ranked[:-1])[: len(keys)]
    place = np.cumsum(edge) - 1
    if order is None:
        return ranked[edge], place
    out = np.empty(len(keys), np.int64)
    out[order] = place
    return ranked[edge], out


# 3. Seatings

@lru_cache(maxsize=8)
def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers of up to EXACT customers (rows 1, 2, …) at 1 to as many tables, row by row."""
    rows = [np.zeros(1)]
    with np.errstate(divide="ignore"):
        for c in range(1, EXACT):
            stay = np.append(rows[-1] + np.log(c - discount * np.arange(1, c + 1)), -np.inf)
            rows.append(np.logaddexp(stay, np.insert(rows[-1], 0, -np.inf)))
    return np.concatenate(rows)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series above 8."""
    high = x + 8
    return (high - 0.5) * np.log(high) - high + 0.5 * math.log(2 * math.pi) + 1 / (12 * high) - 1 / (360 * high**3) - sum(np.log(x + i) for i in range(8))


def _root(rises, like: np.ndarray) -> np.ndarray:
    """Where a falling function of a number from -700 to 0 changes its sign, by halving."""
    low, high = np.full(like.shape, -700.0), np.full(like.shape, -1e-15)
    for _ in range(56):
        middle = (low + high) / 2
        up = rises(middle)
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def _few(c: np.ndarray, weight: np.ndarray, d: float, drawn: np.ndarray) -> np.ndarray:
    """seated() for many customers at at most FEW tables: Sibuya sums by their series, which falls fast as FEW is far below c**d."""
    k = np.arange(1, FEW + 1)
    size = _log_gamma(d * k + 1) + _log_gamma(c[:, None] - d * k) - _log_gamma(c + 1)[:, None]
    terms = np.exp(size - size[:, :1]) * np.where(k % 2, 1.0, -1.0) * np.sin(math.pi * d * k)
    chosen = np.array([[math.comb(t, j) for j in k] for t in k], np.float64)
    p = np.maximum(terms @ chosen.T, 1e-300)
    logs = np.log(p) + k * np.log(weight / d)[:, None] - _log_gamma(k + 1.0)
    total = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
    return np.minimum(1 + (total < (drawn * total[:, -1])[:, None]).sum(1), FEW)


def _series(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Log probability that t Sibuya sizes sum to c."""
    total, chosen, scale = np.zeros(len(c)), np.ones(len(c)), c**-d
    for k in range(1, TERMS + 1):
        chosen = chosen * (t - k + 1) / k * scale
        total += chosen * math.exp(math.lgamma(d * k + 1)) * math.sin(math.pi * d * k) * (1 if k % 2 else -1) * np.exp(_log_gamma(c - d * k) - _log_gamma(c + 1) + np.log(c) * (d * k + 1))
    return np.log(np.maximum(total, 1e-300) / (math.pi * c))


def _many(c: np.ndarray, weight: np.ndarray, d: float, drawn: np.ndarray) -> np.ndarray:
    """seated() for many customers, at nodes: t tables are a Poisson number of Sibuya sizes, given that they sum to c."""
    # u is the log of one minus the sizes' tilt; first the mode and the spread of t, then weights at nodes around it
    u = _root(lambda u: np.log(weight / c) + np.log(-np.expm1(u)) + (d - 1) * u > 0, c)
    mode = weight / d * -np.expm1(d * u)
    rise = 1 + (1 - d) * -np.expm1(u) * np.exp(-u)
    reach = 8 * np.sqrt(np.maximum(0.0, mode - c / rise)) + 8
    few = mode + reach <= np.minimum(FEW, c**d / 3)
    if few.any():
        out = np.empty(len(c), np.int64)
        out[few] = _few(c[few], weight[few], d, drawn[few])
        if not few.all():
            out[~few] = _many(c[~few], weight[~few], d, drawn[~few])
        return out
    low, high = np.maximum(0.5, mode - reach), np.minimum(c - 0.5, mode + reach)
    t = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, NODES)
    n = c[:, None]
    u = _root(lambda u: np.log(t * d / n) + np.log(-np.expm1(u)) + (d - 1) * u - np.log(-np.expm1(d * u)) > 0, t)
    spread = t * (n / t) * (1 + (1 - d) * -np.expm1(u) * np.exp(-u) - n / t)
    sums = t * np.log(-np.expm1(d * u)) - n * np.log(-np.expm1(u)) - 0.5 * np.log(2 * math.pi * np.maximum(spread, 1e-300))
    # one large size stands out at tables well below c**d, where the series converges and the saddle point is poor
    heavy = t <= 1.2 * n**d
    if heavy.any():
        sums[heavy] = _series(np.broadcast_to(n, t.shape)[heavy], t[heavy], d)
    logs = t * np.log(weight / d)[:, None] - _log_gamma(t + 1) + sums
    dense = np.exp(logs - logs.max(1, keepdims=True))
    steps_ = np.cumsum((dense[:, 1:] + dense[:, :-1]) / 2, 1)
    drawn = drawn * steps_[:, -1]
    at = (steps_ < drawn[:, None]).sum(1)
    row = np.arange(len(c))
    before = np.where(at > 0, steps_[row, at - 1], 0.0)
    share = (drawn - before) / np.maximum(steps_[row, at] - before, 1e-300)
    return np.clip(np.rint(t[row, at] + share * (t[row, at + 1] - t[row, at])), 1, c).astype(np.int64)


def _together(numbers: np.ndarray, weight: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """seated() for dishes of one number of customers, whose Stirling numbers are given."""
    sums, power, so_far = [], np.ones(len(weight)), np.zeros(len(weight))
    for number in numbers.tolist():
        power = power * weight
        so_far = so_far + number * power
        sums.append(so_far)
    out = np.ones(len(weight), np.int64)
    wanted = drawn * so_far
    for x in sums[:-1]:
        out += x <= wanted
    return out


def seated(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator | np.ndarray) -> np.ndarray:
    """The number of tables at which each dish's customers sit when all are seated anew.

    It is drawn in proportion to weight**tables times the generalised Stirling number, in which table sizes are summed
    out: exactly up to EXACT customers, beyond by a series and a saddle point for
    the sums of table sizes. `rng` may be an array with each dish's number from 0 to 1.
    """
    drawn = rng if isinstance(rng, np.ndarray) else rng.random(len(customers))
    out = np.minimum(customers, 1)
    table = _stirling(discount)
    small = (customers > 1) & (customers <= SMALL) & (weight < LARGE_WEIGHT)
    rows = np.flatnonzero(small)
    rows = rows[np.argsort(customers[rows].astype(np.uint8), kind="stable")]
    edges = np.searchsorted(customers[rows], np.arange(2, SMALL + 2))
    for n, a, b in zip(range(2, SMALL + 1), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = rows[a:b]
        out[own] = _together(np.exp(table[n * (n - 1) // 2 :][:n]), weight[own], drawn[own])
    rows = np.flatnonzero((customers > 1) & (customers <= EXACT) & ~small)
    ends = np.cumsum(customers[rows])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DRAWN, side="right")))
        own, n = rows[at:stop], customers[rows[at:stop]]
        first = np.cumsum(n) - n
        tables = np.arange(int(n.sum())) - np.repeat(first, n) + 1
        logs = table[ragged(n * (n - 1) // 2, n)] + tables * np.repeat(np.log(weight[own]), n)
        total = np.cumsum(np.exp(logs - np.repeat(np.maximum.reduceat(logs, first), n)))
        low = np.where(first > 0, total[first - 1], 0.0)
        last = first + n - 1
        out[own] = tables[np.clip(np.searchsorted(total, low + drawn[own] * (total[last] - low), side="right"), first, last)]
        at = stop
    rows = np.flatnonzero(customers > EXACT)
    for at in range(0, len(rows), 2000):
        own = rows[at : at + 2000]
        out[own] = _many(customers[own].astype(np.float64), weight[own], discount, drawn[own])
    return out


def uniform(first: np.ndarray, second: np.ndarray, seed: int, turn: int, level: int) -> np.ndarray:
    """Numbers from 0 to 1 by hash, so that a dish's draw is the same in whatever shard."""
    salt = mix(np.array([(seed << 32) + (turn << 8) + level + 1], np.uint64))
    return (mix(mix(first ^ salt) + second) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Shard:
    """All seatings of one shard: pairs of a context and a word below, dishes of its classes above. Table sizes are summed out."""

    def __init__(self, context: np.ndarray, word: np.ndarray, counts: np.ndarray, group: np.ndarray, parts: np.ndarray, n_words: int):
        """Pairs, each once; each context's class, and to how many shards that is dealt."""
        self.word, self.n_words, self.context, self.c = word, n_words, context, counts.astype(np.int64)
        dishes, self.up = _placed(group[context] * n_words + word)
        self.group, self.dish_word = np.divmod(dishes, n_words)
        self.contexts, self.classes = len(parts), int(group.max()) + 1 if len(group) else 0
        self.split, self.split_classes = np.flatnonzero(parts > 1), np.unique(group[parts > 1])
        self.whole: list[np.ndarray] | None = None
        self.customers: np.ndarray | None = None
        self.seat(np.minimum(self.c, 1))

    def seat(self, tables: np.ndarray, above_tables: np.ndarray | None = None) -> None:
        self.t = tables
        self.above = np.bincount(self.up, self.t, len(self.group)).astype(np.int64)
        self.above_t = np.minimum(self.above, 1) if above_tables is None else above_tables

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.dish_word, self.above_t, self.n_words).astype(np.int64)

    def own_totals(self) -> list[np.ndarray]:
        """Customers and tables of each context, and of each class, as far as they are here."""
        n, m = self.contexts, self.classes
        if self.customers is None:  # these stay as they are
            self.customers = np.bincount(self.context, self.c, n)
        return [self.customers.copy(), np.bincount(self.context, self.t, n), np.bincount(self.group, self.above, m), np.bincount(self.group, self.above_t, m)]

    def _totals(self) -> list[np.ndarray]:
        return self.own_totals() if self.whole is None else self.whole

    def partial(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the contexts and classes that other shards have a part of."""
        own = self.own_totals()
        return tuple(np.concatenate([own[i][self.split], own[2 + i][self.split_classes]]).astype(np.int64) for i in range(2))

    def complete(self, customers: np.ndarray, tables: np.ndarray) -> None:
        """Takes the sums of partial() over all shards."""
        self.whole, n = self.own_totals(), len(self.split)
        for i, x in enumerate((customers, tables)):
            self.whole[i][self.split], self.whole[2 + i][self.split_classes] = x[:n], x[n:]

    def _of_classes(self, root: np.ndarray, s: Settings, d: tuple[float, ...], customers: np.ndarray | None = None, tables: np.ndarray | None = None) -> np.ndarray:
        if customers is None:
            *_, customers, tables = self._totals()
        return (self.above - d[1] * self.above_t + (s.strengths[1] + d[1] * tables[self.group]) * root[self.dish_word]) / (s.strengths[1] + customers[self.group])

    def chances(self, root: np.ndarray, s: Settings, d: tuple[float, ...]) -> np.ndarray:
        """Predictive probability of each pair, given the root's of each word."""
        customers, tables, *classes = self._totals()
        parent = self._of_classes(root, s, d, *classes)[self.up]
        return (self.c - d[2] * self.t + (s.strengths[2] + d[2] * tables[self.context]) * parent) / (s.strengths[2] + customers[self.context])

    def sweep(self, root: np.ndarray, s: Settings, d: tuple[float, ...], rng: np.random.Generator | Callable[[int, np.ndarray], np.ndarray]) -> None:
        """Gibbs: all customers of the contexts are seated anew, then all of the classes. A dish's only customer has one table."""
        draw = rng if callable(rng) else lambda _, rows: rng.random(len(rows))
        _, tables, customers, above = self._totals()
        rows = np.flatnonzero(self.c > 1)
        dish, context = self.up[rows], self.context[rows]
        parent = self._of_classes(root, s, d, customers, above)[dish]
        self.t = np.minimum(self.c, 1)
        self.t[rows] = seated(self.c[rows], (s.strengths[2] + d[2] * tables[context]) * parent, d[2], draw(2, rows))
        self.above = np.bincount(self.up, self.t, len(self.group)).astype(np.int64)
        rows = np.flatnonzero(self.above > 1)
        self.above_t = np.minimum(self.above, 1)
        self.above_t[rows] = seated(self.above[rows], (s.strengths[1] + d[1] * above[self.group[rows]]) * root[self.dish_word[rows]], d[1], draw(1, rows))
        self.whole = None


def root_chances(customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float, known: float, s: Settings, d: float) -> np.ndarray:
    """The root's predictive probabilities; words without training tokens are the unknown word."""
    base = np.where(customers > 0, (1 - s.unknown) / max(1.0, known), s.unknown)
    return (customers - d * tables + (s.strengths[0] + d * all_tables) * base) / (s.strengths[0] + all_customers)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one value; the input is sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[column] != now:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


class Part(Shard):
    """A shard of a corpus, from its pieces: also its contexts' and words' hashes, and its words' training counts."""

    def __init__(self, names: np.ndarray, endings: np.ndarray, hashes: np.ndarray, context: np.ndarray, word: np.ndarray, counts: np.ndarray, plan: Plan):
        self.names, self.endings, self.hashes, self.owners = names, endings, hashes, plan.owners
        self.ends, group = np.unique(endings, return_inverse=True)
        super().__init__(context, word, counts, group, plan.parts[endings], len(hashes))
        self.counts = np.bincount(word, self.c, len(hashes)).astype(np.int64)
        salts = mix(np.arange(1, 3, dtype=np.uint64))
        self.keys = np.concatenate([mix(names[self.split] ^ salts[0]), mix(self.ends[self.split_classes].astype(np.uint64) ^ salts[1])])

    @staticmethod
    def of(parts: list[bytes], plan: Plan) -> Part:
        """From what whole_row() gave."""
        names, endings, hashes, words, sizes, context, counts = (unpacked(x, kind) for x, kind in zip(parts, _WHOLE, strict=True))
        return Part(names, endings, hashes, context.astype(np.int64), np.repeat(words.astype(np.int64), sizes), counts, plan)

    def whole_row(self) -> list[bytes]:
        """The shard as one row: its pairs are in the order of dishes."""
        arrays = self.names, self.endings, self.hashes, self.dish_word, np.bincount(self.up, minlength=len(self.group)), self.context, self.c
        return [packed(x.astype(kind)) for x, kind in zip(arrays, _WHOLE, strict=True)]

    @staticmethod
    def merged(pieces: list[list[bytes]], plan: Plan) -> tuple[Part, list[int], np.ndarray, list[np.ndarray]]:
        """Also each piece's number of pairs, places of all pairs, and words."""
        contexts, endings, sizes, words, of, counts = zip(*map(_arrays, pieces), strict=True)
        names, one, at = np.unique(np.concatenate(contexts), return_index=True, return_inverse=True)
        hashes, place = np.unique(np.concatenate(words), return_inverse=True)
        word_starts = np.cumsum([0, *map(len, words)])
        word = place[np.concatenate([x.astype(np.int64) + a for x, a in zip(of, word_starts[:-1], strict=True)])]
        # in the order of (class, word, context), so that a dish's pairs stand together; a shard has some 2**21 of each at most
        endings = np.concatenate(endings)[one]
        of_class, context = np.unique(endings, return_inverse=True)[1], np.repeat(at, np.concatenate(sizes))
        pairs, where = np.unique((of_class[context] * len(hashes) + word) * len(names) + context, return_inverse=True)
        dish, context = np.divmod(pairs, len(names))
        part = Part(names, endings, hashes, context, dish % len(hashes), np.bincount(where, np.concatenate(counts), len(pairs)), plan)
        return part, [len(x) for x in of], where, np.split(place, word_starts[1:-1])

    def asked(self, shard: int) -> list[tuple]:
        """Rows for owners: words with the root's customers and training counts, keys of other sums with these, and counts of dishes with one and with two customers."""
        few = np.array([(x == k).sum() for x in (self.c, self.above) for k in (1, 2)], np.int64)
        (order, starts), (others, ends) = _by_owner(self.hashes, self.owners), _by_owner(self.keys, self.owners)
        words, sums = (self.hashes, self.root_customers(), self.counts), (self.keys, *self.partial())
        rows = []
        for k in range(self.owners):
            own, more = order[starts[k] : starts[k + 1]], others[ends[k] : ends[k + 1]]
            if len(own) or len(more):
                rows.append((shard, ASKED, k, [packed(x[i] if x.dtype == np.uint64 else x[i].astype(np.uint32)) for columns, i in ((words, own), (sums, more)) for x in columns] + [b"" if rows else few.tobytes()]))
        return rows

    def answered(self, sums: list[list[bytes]], totals: dict[str, int], s: Settings, d: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Takes what the owners sent back, in their order: gives each word's probability in the root, and its training tokens in the corpus."""
        (order, _), (others, _) = _by_owner(self.hashes, self.owners), _by_owner(self.keys, self.owners)
        words, more = np.empty((3, len(order)), np.int64), np.empty((2, len(others)), np.int64)
        for out, at, i in ((words, order, 0), (more, others, 1)):
            out[:, at] = np.concatenate([unpacked(x[i], np.int64).reshape(len(out), -1) for x in sums], axis=1)
        self.complete(*more)
        return root_chances(words[0], words[1], totals["customers"], totals["tables"], totals["known"], s, d[0]), words[2]

    def draws(self, s: Settings, turn: int) -> Callable[[int, np.ndarray], np.ndarray]:
        """Of pairs at level 2, of classes' dishes at level 1."""

        def draw(level: int, rows: np.ndarray) -> np.ndarray:
            names, word = (self.names[self.context[rows]], self.word[rows]) if level == 2 else (self.ends[self.group[rows]].astype(np.uint64), self.dish_word[rows])
            return uniform(names, self.hashes[word], s.seed, turn, level)

        return draw


_WHOLE = np.uint64, np.uint16, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32


def _arrays(parts: list[bytes]) -> list[np.ndarray]:
    return [unpacked(x, kind) for x, kind in zip(parts, (np.uint64, np.uint16, np.uint32, np.uint64, np.uint32, np.uint32), strict=True)]


def _by_owner(keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by owner, and where each owner's begin, with the end."""
    owner = ((mix(keys) >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(owners + 1))


def _of_kind(rows: list[dict], kind: int) -> list[list[bytes]]:
    return [r["parts"] for r in rows if r["kind"] == kind]


def _begin(plan: Plan):
    """Each shard's pieces as one, and what it asks for before the first sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "shard"):
            part, *_ = Part.merged(_of_kind(rows, PIECE), plan)
            yield from _rows([(number, PIECE, -1, part.whole_row()), *part.asked(number)])
        release()

    return run


@dataclass(frozen=True)
class Turn:
    """The sweep to come, what was summed up after the one before, and whether the seatings as they are count."""

    number: int
    totals: dict[str, int]
    discounts: tuple[float, ...]
    kept: bool


def _taken(part: Part, rows: list[dict], turn: Turn, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gives a shard its seatings and sums; also the root's chances, words' counts, and the sum of predictive probabilities so far."""
    mean = np.zeros(len(part.c), np.float32)
    for tables, above_tables, so_far in _of_kind(rows, STATE):
        part.seat(unpacked(tables, np.uint32).astype(np.int64), unpacked(above_tables, np.uint32).astype(np.int64))
        mean = np.frombuffer(so_far, np.float32) if so_far else mean
    root, counts = part.answered(_of_kind(rows, SUMS), turn.totals, s, turn.discounts)
    return root, counts, mean + part.chances(root, s, turn.discounts).astype(np.float32) if turn.kept else mean


def _sweep(plan: Plan, turn: Turn, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "shard"):
            part = Part.of(_of_kind(rows, PIECE)[0], plan)
            root, _, mean = _taken(part, rows, turn, s)
            part.sweep(root, s, turn.discounts, part.draws(s, turn.number))
            state = [packed(part.t.astype(np.uint32)), packed(part.above_t.astype(np.uint32)), mean.tobytes() if turn.kept else b""]
            yield from _rows([(number, STATE, -1, state), *part.asked(number)])
        release()

    return run


_SUMMED = _ROW + ", totals array<long>"
_TOTALS = ("customers", "tables", "known", "root_1", "root_2", "leaf_1", "leaf_2", "class_1", "class_2")


def _add(turn: Turn | None, s: Settings):
    """An owner's sums, sent back to all who asked; the root's customers of its words are seated. Without a turn all sit at one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "of"):
            asked = [[unpacked(x, kind) for x, kind in zip(r["parts"], (np.uint64, np.uint32, np.uint32) * 2, strict=False)] for r in rows]
            (hashes, place, customers, counts), (_, more, first, second) = (_added([x[i : i + 3] for x in asked]) for i in (0, 3))
            known, tables = int((counts > 0).sum()), np.minimum(customers, 1)
            if turn:
                d, base = turn.discounts[0], (1 - s.unknown) / max(1, turn.totals["known"])
                tables = seated(customers, np.full(len(hashes), (s.strengths[0] + d * turn.totals["tables"]) * base), d, uniform(hashes, hashes, s.seed, turn.number, 0))
            few = sum((np.frombuffer(r["parts"][6], np.int64) for r in rows if r["parts"][6]), np.zeros(4, np.int64))
            totals = [int(customers.sum()), int(tables.sum()), known, int((customers == 1).sum()), int((customers == 2).sum()), *few.tolist()]
            words, sums, out, a, b = np.stack([customers, tables, counts]), np.stack([first, second]), [], 0, 0
            for r, x in zip(rows, asked, strict=True):
                back = [packed(words[:, place[a : (a := a + len(x[0]))]].ravel()), packed(sums[:, more[b : (b := b + len(x[3]))]].ravel())]
                out.append((r["shard"], SUMS, number, back, None if out else totals))
            yield from _rows(out, _SUMMED)
        release()

    return run


def _added(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Distinct keys, the place of each given one among them, and the two columns' sums."""
    keys, place = _placed(np.concatenate([x[0] for x in parts]))
    return keys, place, *(np.bincount(place, np.concatenate([x[i] for x in parts]), len(keys)).astype(np.int64) for i in (1, 2))


# 4. Answers

_ANSWER = "chunk long, shard long, logs binary, counts binary, docs binary, n_tokens binary, held binary, stream binary, words binary, endings binary"


def _answers(plan: Plan, turn: Turn, s: Settings):
    """For each chunk the log10 probability of each pair it asked for, and the counts of the piece's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "shard"):
            part, lengths, where, words_of_piece = Part.merged(_of_kind(rows, PIECE), plan)
            _, counts, mean = _taken(part, rows, turn, s)
            logs, ends = np.rint(-np.log10(mean.astype(np.float64) / s.kept) * FIXED).astype(np.uint32), np.cumsum(lengths)
            for i, chunk in enumerate(r["of"] for r in rows if r["kind"] == PIECE):
                yield _answer_row(chunk=chunk, shard=number, logs=packed(logs[where[ends[i] - lengths[i] : ends[i]]]), counts=packed(counts[words_of_piece[i]].astype(np.uint32)))
        release()

    return run


def _answer_row(**row) -> pa.RecordBatch:
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row.get(n)], pa.int64() if i < 2 else pa.binary()) for i, n in enumerate(names)], names=names)


# 5. Scores

_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(plan: Plan, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "chunk"):
            head, c = rows[0], Chunk(rows[0])
            answers = {r["shard"]: r for r in rows[1:]}
            _, word, _, stream, order, found, starts = c.dealt(plan)
            logs, counts = np.empty(len(word)), np.zeros(len(c.words), np.int64)
            for k, a, b in zip(found.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = order[a:b]
                logs[own] = unpacked(answers[k]["logs"], np.uint32) / -FIXED
                counts[np.unique(word[own])] = unpacked(answers[k]["counts"], np.uint32)
            firsts = np.cumsum(c.sizes) - c.sizes
            base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
            ids = np.frombuffer(head["docs"], np.int64).reshape(-1, 2)
            add = lambda x: np.add.reduceat(x, firsts)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[:, 1], mask=ids[:, 0] == 1), pa.array(c.held), pa.array(c.sizes), pa.array(add((counts > 0).astype(np.int64)[c.stream])), pa.array(add(base[c.stream])), pa.array(add(logs[stream]))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )
        release()

    return run


def discounts(totals: dict[str, int], s: Settings) -> tuple[float, ...]:
    """Each level's n1 / (n1 + 2 n2), the root's first, kept off 0 and 1; the settings' where there is nothing to count."""
    out = []
    for level, given in zip(("root", "class", "leaf"), s.discounts, strict=True):
        one, two = totals[f"{level}_1"], totals[f"{level}_2"]
        out.append(min(0.95, max(0.1, one / (one + 2 * two))) if one and two else given)
    return tuple(out)


def language_model_scores(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; perplexity besides."""
    chunks = written(id_and_text(docs, id_col, text_col).mapInArrow(_chunks(s), _CHUNK), "chunks", "zstd")
    n = int(chunks.agg(F.sum("train_tokens")).first()[0] or 0)
    endings = chunks.select("sums").mapInArrow(_endings, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    plan = Plan.of({r["key"]: r["n"] for r in endings.collect()}, s.shard_tokens)  # at most 65,536
    shards = plan.shards_total
    pieces = chunks.select("chunk", "n_tokens", "held", "stream", "words", "endings").mapInArrow(_pieces(plan), _ROW)
    by_shard = lambda rows: rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind", "of")

    def summed(asking: DataFrame, turn: Turn | None) -> tuple[DataFrame, dict[str, int]]:
        """What owners send back to the shards that ask, and the sums of all owners."""
        asked = asking.where(F.col("kind") == ASKED).repartitionById(plan.owners, F.col("of").cast("int")).sortWithinPartitions("of", "shard")
        back = written(asked.mapInArrow(_add(turn, s), _SUMMED), "sums", "zstd")
        totals = back.where("totals is not null").agg(*[F.sum(F.get("totals", F.lit(i))).alias(x) for i, x in enumerate(_TOTALS)]).first().asDict()
        return back, {k: v or 0 for k, v in totals.items()}

    begun = written(by_shard(pieces).mapInArrow(_begin(plan), _ROW), "begun")
    wholes = begun.where(F.col("kind") == PIECE)
    back, totals = summed(begun, None)
    given, done, d = back.drop("totals"), [back], s.discounts
    for number in range(last := s.own_sweeps + s.burn_in + s.kept):
        d = discounts(totals, s) if number == s.own_sweeps else d
        turn = Turn(number, totals, d, number > last - s.kept)
        swept = written(by_shard(wholes.union(given)).mapInArrow(_sweep(plan, turn, s), _ROW), "swept")
        removed(*done)
        back, totals = summed(swept, turn)
        given, done = swept.where(F.col("kind") == STATE).union(back.drop("totals")), [swept, back]
    removed(begun)
    answers = written(by_shard(pieces.union(given)).mapInArrow(_answers(plan, Turn(last, totals, d, True), s), _ANSWER), "answers")
    removed(*done)
    none = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    heads = chunks.select("chunk", F.lit(-1).cast("long").alias("shard"), *none("logs", "counts"), "docs", "n_tokens", "held", "stream", "words", "endings")
    scored = answers.union(heads).repartition(shards, "chunk").sortWithinPartitions("chunk", "shard").mapInArrow(_scores(plan, n, totals["known"]), _SCORE)
    scored = written(scored.withColumn("train_tokens", F.lit(n).cast("long")), "scores")
    removed(chunks, answers)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
