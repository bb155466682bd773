"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database in each Python worker.

Texts are cut into segments and these into pre-tokens by the public pattern; each distinct one that a worker hasn't met
goes through DuckDB. A pre-token that joins the vocabulary as a whole is its token, as in the library. Those of up to
`SHORT` bytes go through a query whose token-position rows join the merge table, in which each step contracts every
pre-token's leftmost pair of least rank, until none is left. Longer ones go through a recursive query that is keyed by
position, keeps only the rows' latest state, and contracts all places of the pair of least rank in one step (of
overlapping ones every other, from the left), which comes to the same: a pair that a contraction makes has a higher rank
than the contracted one. Byte pairs that are contracted whatever else is are joined in the rows that the queries start
from. Ordered aggregations give ids and decoded bytes. Batches are bounded by the rows that their
steps may make, not by a count of pre-tokens.

A step of the keyed query rewrites the rows of the pre-tokens that still change, so a pre-token without any repetition
takes time in the square of its length: 30,000 random letters take about 17 s, 300,000 equal ones half a second.

Defined results: a null text counts as empty, with no tokens and the hashes of the empty string; texts are valid UTF-8,
so any text decodes to itself; null ids stay null; repeated rows are encoded alike; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_steps, id_and_text, ragged, release
from .segments import Known, begin_in_space, binary, content, cut

#: Bytes of a pre-token up to which all steps' rows are kept until the end.
SHORT = 48
#: Rows that the steps of one query may make, about; bytes of long pre-tokens in one query.
ROWS, LONG_BYTES = 800_000, 32 << 10
#: Segments and pre-tokens that a worker remembers, and bytes of their results, before it starts anew.
REMEMBERED, REMEMBERED_BYTES = 300_000, 48 << 20
#: Text bytes of one step, and steps whose new pre-tokens are learnt together.
STEP, TOGETHER = 1 << 20, 4

_WHOLE = "SELECT w, id AS tok FROM pieces JOIN vocabulary USING (piece)"
_STEPWISE = """
tokens(w, pos, tok, nxt, prev, done) AS (
  SELECT w, pos, tok, lead(tok) OVER v, lag(pos) OVER v, false FROM start ANTI JOIN whole USING (w) WINDOW v AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  SELECT w, pos, tok, lead(tok) OVER v, lag(pos) OVER v, best IS NULL
  FROM (SELECT t.w, t.pos, b.best, CASE WHEN t.pos = b.best % 65536 THEN b.best // 65536 ELSE t.tok END AS tok
        FROM tokens t JOIN (
          SELECT w, min(merged * 65536 + pos) AS best
          FROM (SELECT w, pos, merged FROM tokens LEFT JOIN merges ON pair = tok * 65536 + nxt WHERE NOT done)
          GROUP BY w) b ON t.w = b.w
        WHERE NOT t.done AND (b.best IS NULL OR t.prev IS NULL OR t.prev <> b.best % 65536))
  WINDOW v AS (PARTITION BY w ORDER BY pos)),
final AS (SELECT w, pos, tok FROM tokens WHERE done)
"""
# tok is -1 where a token was joined to the one before it
_KEYED = """
tokens(w, pos, tok, nxt, merged) USING KEY (w, pos) AS (
  SELECT w, pos, tok, nxt, merged
  FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM start ANTI JOIN whole USING (w)) LEFT JOIN merges ON pair = tok * 65536 + nxt
  UNION
  (WITH least AS (
    SELECT w, min(merged) AS merged FROM recurring.tokens WHERE tok >= 0 AND w IN (SELECT w FROM tokens) GROUP BY w HAVING min(merged) IS NOT NULL),
  live AS (
    SELECT t.w, t.pos, t.tok, t.merged, coalesce(t.merged = b.merged, false) AS best, coalesce(t.merged = b.merged AND t.tok = t.nxt, false) AS twin
    FROM recurring.tokens t JOIN least b ON t.w = b.w WHERE tok >= 0),
  placed AS (SELECT w, pos, twin, row_number() OVER (PARTITION BY w ORDER BY pos) AS place FROM live WHERE w IN (SELECT w FROM live WHERE twin)),
  runs AS (SELECT w, pos, place - row_number() OVER (PARTITION BY w ORDER BY pos) AS run FROM placed WHERE twin),
  odd AS (SELECT w, pos, row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 = 0 AS skipped FROM runs),
  joined AS (
    SELECT w, pos, CASE WHEN lag(chosen) OVER (PARTITION BY w ORDER BY pos) THEN -1 WHEN chosen THEN merged ELSE tok END AS tok
    FROM (SELECT w, pos, tok, merged, best AND NOT coalesce(skipped, false) AS chosen FROM live LEFT JOIN odd USING (w, pos)))
  SELECT w, pos, tok, nxt, merged
  FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM joined WHERE tok >= 0) LEFT JOIN merges ON pair = tok * 65536 + nxt
  UNION ALL SELECT w, pos, -1, NULL, NULL FROM joined WHERE tok < 0)),
final AS (SELECT w, pos, tok FROM tokens WHERE tok >= 0)
"""
_RESULT = """
SELECT w, count(*) AS n, CAST(string_agg(number, '' ORDER BY pos) AS BLOB) AS ids, unhex(string_agg(hex, '' ORDER BY pos)) AS plain
FROM (SELECT * FROM final UNION ALL SELECT w, 0, tok FROM whole) JOIN vocabulary ON id = tok GROUP BY w ORDER BY w
"""


def _query(steps: str) -> str:
    return f"WITH RECURSIVE whole AS MATERIALIZED ({_WHOLE}), {steps} {_RESULT}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: No rank of a pair.
NONE = 1 << 30


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """The pair whose contraction gives a token when its own bytes are encoded: no other pair of this sum ever comes up, in whatever text."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NONE:
            return ()
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def byte_pairs(ranks: dict[bytes, int], left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By two bytes: the rank of their pair; the least rank of the first one with any token that begins with the second; and of any token that ends with the first with the second."""
    of = np.full(1 << 16, -1)
    of[[ranks[bytes([i])] for i in range(256)]] = range(256)
    ends = np.zeros((2, 1 << 16), np.int64)
    ends[:, list(ranks.values())] = np.array([(t[0], t[-1]) for t in ranks]).T
    out = np.full((3, 256, 256), NONE)
    for table, a, b in zip(out, (of[left], of[left], ends[1][left]), (of[right], ends[0][right], of[right]), strict=True):
        here = (a >= 0) & (b >= 0)
        np.minimum.at(table, (a[here], b[here]), merged[here])
    return tuple(out)


def certain(raw: np.ndarray, firsts: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Marks the bytes that are joined to the next one whatever else is contracted.

    Whatever the bytes beside a pair grow into, its contraction comes first if its rank is below that of either byte with
    any token on its other side; and as a contraction makes pairs of higher rank only, it may be done at the start.
    """
    rank, after, before = tables
    out = np.zeros(len(raw), bool)
    if len(raw) < 2:
        return out
    pair = rank[raw[:-1], raw[1:]]
    inner = np.ones(len(raw) + 1, bool)
    inner[firsts] = inner[-1] = False  # False where a pre-token begins
    least = np.full((2, len(raw) - 1), NONE)
    least[0, :-1] = np.where(inner[2:-1], after[raw[1:-1], raw[2:]], NONE)
    least[1, 1:] = np.where(inner[1:-2], before[raw[:-2], raw[1:-1]], NONE)
    out[:-1] = inner[1:-1] & (pair < least[0]) & (pair < least[1])
    return out


class Results:
    """For numbered pieces of text: numbers of tokens, decimal ids (each with a comma after it) and decoded bytes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known, self.counts = Known(), np.empty(0, np.int64)
        self.ids = self.plain = pa.array([], pa.large_binary())

    def add(self, counts: np.ndarray, ids: pa.Array, plain: pa.Array) -> None:
        self.counts, self.ids, self.plain = np.concatenate([self.counts, counts]), pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.plain, plain])

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or self.ids.nbytes + self.plain.nbytes > REMEMBERED_BYTES

    def joined(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Results of sequences of pieces, `sizes` in each, one after the other."""
        edges = np.append(0, np.cumsum(sizes))
        counts = np.diff(np.append(0, np.cumsum(self.counts[numbers]))[edges])
        out = []
        for column in (self.ids, self.plain):
            raw, at = content(pc.take(column, pa.array(numbers)))
            out.append(binary(raw, at[edges]))
        return counts, *out


class Coder:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.ranks, self.pattern = read_ranks(ranks_path), regex.compile(pattern)
        if max(self.ranks.values()) >= 65536:
            raise ValueError("pairs are packed with 16 bits for an id")
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        entries = list(self.ranks.items())
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        # a rank below a part's: such pairs don't come up where ranks are in the order of training
        falls = merged < np.maximum(left, right)
        tokens = {i: t for t, i in entries}
        real = [last_pair(tokens[m], self.ranks) == (tokens[a], tokens[b]) for a, b, m in zip(*(x[falls].tolist() for x in (left, right, merged)), strict=True)]
        falls[falls] = ~np.array(real, bool)
        left, right, merged = left[~falls], right[~falls], merged[~falls]
        self.merges = pa.table({"pair": left * 65536 + right, "merged": merged})
        self.byte_pairs = byte_pairs(self.ranks, left, right, merged)
        if any(real):
            self.byte_pairs[0][:] = NONE  # certain() asks for ranks that rise
        self.vocabulary = pa.table({"id": pa.array([i for _, i in entries], pa.int64()), "number": [f"{i}," for _, i in entries], "hex": [b.hex() for b, _ in entries], "piece": pa.array([b for b, _ in entries], pa.binary())})
        self.db = None
        self.pieces, self.segments = Results(), Results()

    def open(self) -> None:
        """A database in memory for one task, without a folder to spill to; what is known of pre-tokens outlasts it."""
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.db.register("m", self.merges)
        self.db.register("v", self.vocabulary)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocabulary AS SELECT * FROM v")

    def close(self) -> None:
        if self.db:
            self.db.close()
        self.db = None
        release()

    def _contract(self, pieces: pa.Array, steps: str) -> pa.Table:
        """One recursive query over pre-tokens; rows in their order."""
        raw, at = content(pieces)
        sizes = np.diff(at)
        where = np.repeat(np.arange(len(sizes)), sizes)
        self.db.register("pieces", pa.table({"w": np.arange(len(sizes)), "piece": pieces}))
        joined = certain(raw, at[:-1], self.byte_pairs)
        token, kept = self.of_byte[raw], np.append(True, ~joined[:-1])[: len(raw)]
        token[joined] = self.byte_pairs[0][raw[joined], raw[np.flatnonzero(joined) + 1]]
        self.db.register("start", pa.table({"w": where[kept], "pos": (np.arange(len(raw)) - at[where])[kept], "tok": token[kept]}))
        out = self.db.sql(_query(steps)).to_arrow_table()
        self.db.unregister("start")
        self.db.unregister("pieces")
        return out

    def learn(self, new: pa.Array) -> None:
        """Encodes and decodes pre-tokens, shorter ones first."""
        if not self.db:
            self.open()
        sizes = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(sizes, kind="stable")
        cost = np.where(sizes[order] <= SHORT, sizes[order] ** 2 / 2 / ROWS, sizes[order] / LONG_BYTES)
        short, total, at, parts = int((sizes <= SHORT).sum()), np.cumsum(cost), 0, []
        while at < len(order):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 1, side="right")))
            stop = min(stop, short) if at < short else stop
            parts.append(self._contract(new.take(pa.array(order[at:stop])), _STEPWISE if at < short else _KEYED))
            at = stop
        found = pa.concat_tables(parts)
        back = pa.array(np.argsort(order))
        self.pieces.add(*(f(found.column(n).combine_chunks().take(back)) for n, f in (("n", lambda x: x.to_numpy().astype(np.int64)), ("ids", _large), ("plain", _large))))

    def _split(self, new: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of segments, and how many each has; segments that begin in white space are read as one text."""
        texts, joined = [s.decode("utf-8", "replace") for s in new.to_pylist()], begin_in_space(new)
        plain, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        found = self.pattern.findall("".join([texts[i] for i in plain.tolist()]))
        pieces = pa.array(found, pa.large_string()).cast(pa.large_binary())
        lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = np.cumsum(pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64)[plain])
        ends = np.cumsum(lengths)
        last = np.searchsorted(ends, wanted)
        if len(plain) and (not len(ends) or ends[-1] != wanted[-1] or (ends[last] != wanted).any()):
            plain, rest, pieces, last = plain[:0], np.arange(len(new)), pieces[:0], last[:0]
        more = [self.pattern.findall(texts[i]) for i in rest.tolist()]
        sizes = np.concatenate([np.diff(last, prepend=-1), np.array(list(map(len, more)), np.int64)])
        pieces = pa.concat_arrays([pieces, pa.array([p for x in more for p in x], pa.large_string()).cast(pa.large_binary())])
        starts, back = np.cumsum(sizes) - sizes, np.argsort(np.concatenate([plain, rest]))
        return pieces.take(pa.array(ragged(starts[back], sizes[back]))), sizes[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text its number of tokens, decimal ids each with a comma after it, and the bytes that they decode to."""
        return next(self.encoded([texts]))

    def encoded(self, steps: list[pa.Array]) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        """The same for each of several steps, whose new pre-tokens are learnt together: a query's fixed cost is shared by more of them."""
        for store in (self.segments, self.pieces):
            if store.full():
                store.clear()
        found, counts = zip(*map(cut, steps), strict=True)
        # once for all steps: a look among the known ones costs as much as there are of these
        numbers, new = self.segments.known.number(pa.concat_arrays(found))
        if len(new):
            pieces, sizes = self._split(new)
            of, unknown = self.pieces.known.number(pieces)
            if len(unknown):
                self.learn(unknown)
            self.segments.add(*self.pieces.joined(of, sizes))
        for own, sizes in zip(np.split(numbers, np.cumsum([len(x) for x in found])[:-1]), counts, strict=True):
            yield self.segments.joined(own, sizes)


def _large(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary())


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> Coder:
    """One for each Python worker; tasks that follow find the pre-tokens of earlier ones."""
    return Coder(ranks_path, pattern)


_SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"


def _encode(ranks_path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks_path, pattern)
        try:
            steps = arrow_steps(batches, limit=STEP)
            while some := list(islice(steps, TOGETHER)):
                for (part, _), (counts, *columns) in zip(some, own.encoded([texts for _, texts in some]), strict=True):
                    out = []
                    for column, cut_off in zip(columns, (1, 0), strict=True):
                        raw, at = content(column)
                        view = memoryview(raw)
                        spans = [view[a : max(a, b - cut_off)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        out.append([hashlib.sha256(x).hexdigest() for x in spans] if digests else [bytes(x).decode("utf-8", "replace") for x in spans])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), *(pa.array(x, pa.string()) for x in out)], names=["doc_id", "n_tokens", "ids", "decoded"])
                    del part, counts, columns, column, raw, at, view, spans, out
                release()
        finally:
            own.close()

    return run


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, decimal ids joined by commas and the decoded text, or with `digests` the SHA-256 of these two."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_encode(ranks_path, pattern, digests), _SCHEMA)
