"""Repair of conversation structure: the cheapest edits that make roles alternate, found for many conversations at once.

Roles must read `(s?(ua)+)?` in initials. A row is kept (0), given the role user or assistant (3) or deleted (4, a must for
blank and repeated rows); empty rows of user or assistant are inserted (3); a truncated row that stays costs 3 more. Of the
cheapest lists of edits the one with the least initials wins.

What the edits depend on is a signature: one symbol of role and fault for each row. Conversations are dealt by ranges of
signatures (and of ids within one, so that a frequent signature is split over tasks) and met in sorted order, which walks
a prefix trie depth first: only the path to the signature at hand is held. Each node has one layer of the dynamic program,
computed once for all signatures that share the prefix, and answers come out at terminal nodes. A layer has, for each
state of the pattern, the least cost, the place of its edits among those of the other states, and the step that led there.

A conversation's rows are read in the order of turn (nulls first), role, text, and its texts travel in packed chunks, so a
task holds one chunk, one signature with its layers (about fifty bytes a row), and sixteen bytes of each row's digest.

Defined results: null roles and texts are one space; a null conversation id is an id like others; repeated rows count each
time; a role's initial is its first character; other columns are ignored; empty tables give no rows. A conversation
without rows left has zeros, an empty audit and no messages. Turns farther apart than a long saturate `gaps`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a packed chunk of texts before compression, and symbols of a signature that rows are dealt by.
CHUNK_BYTES, HEAD = 1 << 20, 256
INSERT, DELETE, REROLE, TRUNCATED = 3, 4, 3, 3
_SPACE, _MOST = " \t\n\x0b\x0c\r", (1 << 63) - 1
#: States of the pattern: nothing yet, after the system's row, after the user's, after the assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_INSERTED = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_MISSING = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_NAME = {USER: "user", ASSISTANT: "assistant"}


def kept(state: int, initial: str) -> int | None:
    """The state after a row that stays with this role, if the pattern allows it."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


class Trie:
    """The path of a prefix trie to the last signature, with a layer of the dynamic program at each node."""

    def __init__(self):
        self.symbols, self.answer = "", None
        self.layers = [((0, 0), None, None, None)]
        self.costs, self.steps = [0], [None]
        self.known: dict = {}
        self.computed = 0

    def _step(self, layer: tuple, symbol: str) -> tuple:
        """(next layer less its least cost, that cost, for each state the (state before, inserts, edit) that led there)."""
        found: dict[int, tuple] = {}
        initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        for before, entry in enumerate(layer):
            if entry is None:
                continue
            cost, place = entry
            state = before
            for inserts in range(3):
                edits = [("D", state, DELETE)]
                if symbol != "-":
                    if (after := kept(state, initial)) is not None:
                        edits.append(("K", after, extra))
                    edits.append(("R", _INSERTED[state], REROLE + extra))
                for edit, after, price in edits:
                    option = (cost + INSERT * inserts + price, place, "I" * inserts + edit, before, inserts)
                    if after not in found or option < found[after]:
                        found[after] = option
                state = _INSERTED[state]
        order = {s: i for i, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
        least = min(x[0] for x in found.values())
        after = tuple((found[s][0] - least, order[s]) if s in found else None for s in range(4))
        return after, least, {s: (x[3], x[4], x[2][-1]) for s, x in found.items()}

    def insert(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature; layers of the prefix that it shares with the one before stay."""
        shared, most = 0, min(len(signature), len(self.symbols))
        if signature[:most] == self.symbols[:most]:
            shared = most
        else:
            low, high = 0, most
            while low < high:  # the first place where they differ
                mid = (low + high + 1) // 2
                low, high = (mid, high) if signature[:mid] == self.symbols[:mid] else (low, mid - 1)
            shared = low
        if shared == len(signature) == len(self.symbols) and self.answer:
            return self.answer
        for held in (self.layers, self.costs, self.steps):
            del held[shared + 1 :]
        for symbol in signature[shared:]:
            layer = self.layers[-1]
            if (layer, symbol) not in self.known:
                self.known[layer, symbol] = self._step(layer, symbol)
            after, cost, steps = self.known[layer, symbol]
            self.computed += 1
            self.layers.append(after)
            self.costs.append(self.costs[-1] + cost)
            self.steps.append(steps)
        self.symbols = signature
        ends = [(x[0] + INSERT * _MISSING[s], x[1], s) for s, x in enumerate(self.layers[-1]) if x]
        cost, _, state = min(ends)
        edits = ["I" * _MISSING[state]]
        for steps in reversed(self.steps[1:]):
            state, inserts, edit = steps[state]
            edits.append("I" * inserts + edit)
        self.answer = self.costs[-1] + cost, "".join(reversed(edits))
        return self.answer


class Replay:
    """Applies an audit to rows that come in chunks; gives (edit, role, text) of what stays or is inserted."""

    def __init__(self, signature: str, audit: str):
        self.signature, self.audit = signature, audit
        self.row = self.at = 0
        self.state = EMPTY

    def feed(self, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        """Goes on until a row is asked for that isn't there."""
        while self.at < len(self.audit):
            edit = self.audit[self.at]
            if edit == "I":
                self.state = _INSERTED[self.state]
                out = edit, _NAME[self.state], ""
            else:
                symbol = self.signature[self.row]
                given = None
                if symbol != "-" and (given := next(rows, None)) is None:
                    return
                self.row += 1
                if edit == "K":
                    self.state = kept(self.state, symbol.lower())
                    out = edit, *given
                elif edit == "R":
                    self.state = _INSERTED[self.state]
                    out = edit, _NAME[self.state], given[1]
                else:
                    out = None
            self.at += 1
            if out:
                yield out


def _pack(rows: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(struct.pack(f"<{len(rows) + 1}I", len(rows), *map(len, rows)) + b"".join(rows))


def _unpack(data: bytes) -> Iterator[tuple[str, str]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", data)
    sizes, at = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n
    for i in range(0, n, 2):
        role, text = data[at : at + sizes[i]], data[at + sizes[i] : at + sizes[i] + sizes[i + 1]]
        at += sizes[i] + sizes[i + 1]
        yield role.decode(), text.decode()


_SIGNED = "head string, mark long, conv_id long, chunk int, signature string, gaps long, blank long, duplicate long, truncated long, illegal long, payload binary"
_SCHEMA = pa.schema([("head", pa.string()), ("mark", pa.int64()), ("conv_id", pa.int64()), ("chunk", pa.int32()), ("signature", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")], ("payload", pa.binary())])


class _Reading:
    """One conversation while its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.chunks, self.rows, self.size = conv_id, [], [], [], 0
        self.seen: set[bytes] = set()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        body = text.strip(_SPACE)
        raw = role.encode(), text.encode()
        digest = hashlib.blake2b(raw[0] + b"\0" + raw[1], digest_size=16, salt=struct.pack("<I", len(raw[0]))).digest()
        again = digest in self.seen
        self.seen.add(digest)
        symbol = initial if initial in ("s", "u", "a") else "x"
        if not body:
            self.blank += 1
            symbol = "-"
        elif again:
            self.duplicate += 1
            symbol = "-"
        elif body[-1] not in ".!?":
            self.truncated += 1
            symbol = symbol.upper()
        self.symbols.append(symbol)
        if symbol != "-":
            self.rows += raw
            self.size += len(raw[0]) + len(raw[1])
            if self.size >= CHUNK_BYTES:
                self.chunks.append(_pack(self.rows))
                self.rows, self.size = [], 0

    def done(self) -> list[tuple]:
        if self.rows or not self.chunks:
            self.chunks.append(_pack(self.rows))
        signature = "".join(self.symbols)
        mark = int.from_bytes(hashlib.blake2b(signature.encode(), digest_size=8).digest(), "little", signed=True)
        gaps = min(self.last - self.first + 1 - self.turns, _MOST) if self.turns else 0
        numbers = gaps, self.blank, self.duplicate, self.truncated, self.illegal
        return [(signature[:HEAD], mark, self.conv_id, i, *((signature, *numbers) if not i else (None,) * 6), x) for i, x in enumerate(self.chunks)]


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, str | bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to signatures with packed texts."""

    def rows() -> Iterator[tuple]:
        now = None
        for batch in batches:
            for conv_id, turn, role, text, gone in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        yield from now.done()
                    now = _Reading(conv_id)
                if not gone:
                    now.add(turn, role, text)
        if now:
            yield from now.done()

    return _batches(rows(), _SCHEMA)


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _NUMBERS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_MESSAGES = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted signatures to (the chunk's row, cost, audit, messages that it gives, whether it's the conversation's first)."""
    trie, replay = Trie(), None
    for batch in batches:
        for row in batch.to_pylist():
            if not row["chunk"]:
                cost, audit = trie.insert(row["signature"])
                replay = Replay(row["signature"], audit)
            yield row, cost, audit, replay.feed(_unpack(row["payload"]))


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held = None
        for row, cost, audit, messages in _answered(batches):
            if not row["chunk"]:
                if held:
                    yield *held, digest.hexdigest()
                held, digest, first = (row["conv_id"], *(row[c] for c in _NUMBERS), cost, audit), hashlib.sha256(), True
            for _, role, text in messages:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if held:
            yield *held, digest.hexdigest()

    return _batches(rows(), _SUMMARY)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        place = 0
        for row, _, _, messages in _answered(batches):
            place = place if row["chunk"] else 0
            for place, (edit, role, text) in enumerate(messages, place + 1):
                yield row["conv_id"], place, edit, role, text

    return _batches(rows(), _MESSAGES)


def _signed(conversations: DataFrame) -> DataFrame:
    """Signatures in sorted ranges. conversations: conv_id, turn, role, text and, where a row is to be left out, gone."""
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), gone.alias("gone"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    signed = rows.mapInArrow(_read, _SIGNED)
    # the id is hashed, so that neighbours among the ids of one signature don't follow the ids' own order
    return signed.withColumn("deal", F.xxhash64("conv_id")).repartitionByRange("head", "mark", "deal", "conv_id").sortWithinPartitions("head", "mark", "deal", "conv_id", "chunk")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired messages: conv_id, place from 1, edit (K, R or I), role, text."""
    return _signed(conversations).mapInArrow(_repaired, "conv_id long, place long, edit string, role string, text string")


def summaries(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost, audit, and the hash of the repaired messages."""
    return _signed(conversations).mapInArrow(_summarised, "conv_id long, " + ", ".join(f"{c} long" for c in [*_NUMBERS, "cost"]) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of `conv_id:turn` modulo 20: 0 marks a row gone, 1 empties it, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    out = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    kind = F.col("kind")
    out = out.withColumns({"role": F.when(kind == 4, "user").otherwise(F.col("role")), "text": F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    return out.select("conv_id", "turn", "role", "text", (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _sql() -> str:
    add = lambda x, cost, edit, line="''": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 't': {x}.t || '{edit}', 'x': {x}.x || {line}}} END"
    least = lambda *options: f"list_min([{', '.join(options)}])"
    put = lambda role: f"chr(10) || '{role}:'"
    line, as_user, as_assistant = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    stay = lambda x, initial: f"CASE WHEN NOT must AND initial = '{initial}' THEN {add(x, 'late', 'K', line)} END"
    turn = lambda x, words: f"CASE WHEN NOT must THEN {add(x, '3 + late', 'R', words)} END"
    return f"""
WITH RECURSIVE src AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM conversations),
bad AS (SELECT id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM bad),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY i) AS again, lag(initial) OVER (PARTITION BY id ORDER BY i) || initial AS pair FROM placed)),
rows AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS late FROM faults),
dp(id, i, e, s, u, a) AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 't': '', 'x': ''}}, {", ".join(["CAST(NULL AS STRUCT(c BIGINT, t VARCHAR, x VARCHAR))"] * 3)} FROM src
  UNION ALL
  SELECT id, i + 1, {add("e", 4, "D")}, {least(add("s", 4, "D"), stay("e", "s"))},
    {least(add("u2", 4, "D"), *(f(x, y) for x in ("e", "s", "a2") for f, y in ((stay, "u"), (turn, as_user))))},
    {least(add("a2", 4, "D"), stay("u2", "a"), turn("u2", as_assistant))}
  FROM (SELECT *, {least("u1", add("a1", 3, "I", put("user")))} AS u2, {least("a1", add("u1", 3, "I", put("assistant")))} AS a2
    FROM (SELECT dp.*, r.role, r.text, r.initial, r.must, r.late, {least("u", *(add(x, 3, "I", put("user")) for x in "esa"))} AS u1, {least("a", add("u", 3, "I", put("assistant")))} AS a1
      FROM dp JOIN rows r ON r.id = dp.id AND r.i = dp.i + 1))),
ends AS (SELECT id, {least("e", "a", add("u", 3, "I", put("assistant")), add("s", 6, "II", put("user") + " || " + put("assistant")))} AS best FROM dp QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1),
told AS (
  SELECT id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.t AS audit, sha256(substr(best.x, 2)) AS repaired_sha256
FROM (SELECT DISTINCT id, conv_id FROM src) c JOIN ends USING (id) LEFT JOIN told USING (id)
"""


ORACLE_SQL = _sql()
