"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control over the whole corpus.

The patterns give spans of the kinds assign, access and hex. The battery looks at every run of encoding characters of at
least `shortest` characters. Its encoding is inferred (decimal, hex, lower or upper case, base32, base36, base64), and

* a chi-squared test of an even spread over the encoding's alphabet, a runs test about the alphabet's middle and a lag-1
  serial correlation test ask whether it looks drawn at random; the smallest of the three p-values times three must reach
  `random_level`;
* the likelihood ratio of a random string to ordinary writing bounds, by Markov's inequality, the chance that ordinary
  writing gives such a string. This p-value falls with length. Benjamini-Hochberg control at `discovery_rate`, within
  bands of length, over all runs of the corpus, sets the largest p-value that counts as a find.

Finds that don't overlap a pattern's span are added with the kind random. p-values are counted in steps of a tenth of a
power of ten, rounded against a find, so what meets on the driver is bounded by bands times steps.

Defined results: a null text counts as empty; without spans the strings are empty (base_sha256 is the empty string's
hash); positions are code points, ends exclusive; null ids stay null; repeated rows are scanned one by one and all count
in the false-discovery control; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release, steps, written

KINDS = ("assign", "access", "hex", "random")
STEPS_PER_TEN, MOST_STEPS = 10, 1000
#: Lower ends of the length bands.
BANDS = (0, 20, 24, 32, 40, 48, 64, 96)


@dataclass(frozen=True)
class Settings:
    shortest: int = 16
    random_level: float = 0.001
    discovery_rate: float = 0.001


# The patterns and least lengths of the three kinds. They hold ASCII only, so they run on the Latin-1 form
# of a text, in which each code point is one byte.
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MARKS = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def _class(i: int) -> bytes:
    c = chr(i)
    return b"d" if c in "0123456789" else b"l" if "a" <= c <= "z" else b"u" if "A" <= c <= "Z" else b"s" if c in "+/_-" else b" "


_CLASSES = b"".join(map(_class, range(256)))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the patterns' matches, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in text.translate(_HEX_MARKS):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


_ALPHABETS = {
    "decimal": "0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Letters by falling frequency in ordinary writing; their weights fall in proportion to 1 / (place + 2).
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz"


def _ordinary() -> np.ndarray:
    """Natural logs of character frequencies in ordinary names, words and paths."""
    q = np.full(256, 1e-6)
    w = np.array([1 / (i + 2) for i in range(26)])
    for c, x in zip(_LETTERS, w / w.sum(), strict=True):
        q[ord(c)], q[ord(c.upper())] = 0.80 * x, 0.09 * x
    for c in "0123456789":
        q[ord(c)] = 0.006
    for c in "+/_=-":
        q[ord(c)] = 0.01
    return np.log(q / q.sum())


_ORDINARY = _ordinary()
#: The same for writing in small letters alone or in capitals alone.
_ONE_CASE = _ORDINARY.copy()
for _case in (slice(97, 123), slice(65, 91)):
    _ONE_CASE[_case] -= np.log(np.exp(_ORDINARY[_case]).sum())
_PLACES = {name: np.array([a.find(chr(i)) for i in range(256)]) for name, a in _ALPHABETS.items()}


def encoding(run: bytes) -> str:
    """The smallest encoding that holds the run."""
    if re.fullmatch(rb"[0-9]+", run):
        return "decimal"
    if re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run):
        return "hex"
    if re.fullmatch(rb"[a-z]+", run):
        return "lower"
    if re.fullmatch(rb"[A-Z]+", run):
        return "upper"
    if re.fullmatch(rb"[A-Z2-7]+", run):
        return "base32"
    if re.fullmatch(rb"[0-9a-z]+", run):
        return "base36"
    return "base64"


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail by the cube-root approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: bytes, name: str) -> tuple[float, float]:
    """log10 of the p-value under ordinary writing, and the least of the three randomness p-values, times three."""
    size = len(_ALPHABETS[name])
    raw = np.frombuffer(run.lower() if name == "hex" else run.replace(b"-", b"+").replace(b"_", b"/"), np.uint8)
    places = _PLACES[name][raw]
    places = places[places >= 0]
    n = len(places)
    if n < 8:
        return 0.0, 0.0
    ratio = -n * math.log(size) - float((_ONE_CASE if name in ("lower", "upper") else _ORDINARY)[np.frombuffer(run, np.uint8)].sum())
    cells = 8 if n >= 40 else 4
    seen = np.bincount(places * cells // size, minlength=cells)
    width = np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    spread = _chi2_tail(float(((seen - n * width) ** 2 / (n * width)).sum()), cells - 1)
    high = places >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    x = places - places.mean()
    var = float((x * x).sum())
    serial = _normal_tail(float((x[1:] * x[:-1]).sum()) / var * math.sqrt(n)) if var else 0.0
    return min(0.0, -ratio / math.log(10)), min(1.0, 3 * min(spread, runs, serial))


def tested(text: bytes, s: Settings) -> list[tuple[int, int, int, float]]:
    """(start, end, steps of the p-value, randomness p-value) of each run; all of them count in the false-discovery control."""
    out = []
    for m in re.finditer(rb"[^ ]{%d,}" % s.shortest, text.translate(_CLASSES)):
        run = text[m.start() : m.end()]
        left = len(run) - len(run.lstrip(b"-_/+"))
        run = run.strip(b"-_/+")
        if len(run) >= s.shortest:
            p, fair = battery(run, encoding(run))
            out.append((m.start() + left, m.start() + left + len(run), min(MOST_STEPS, int(-p * STEPS_PER_TEN)), fair))
    return out


def candidates(text: bytes, s: Settings) -> list[tuple[int, int, int, float]]:
    """The tested runs that are likelier drawn at random than ordinary writing."""
    return [x for x in tested(text, s) if x[2] > 0]


def band(length: int) -> int:
    return max(i for i, low in enumerate(BANDS) if length >= low)


def _plain(text: bytes) -> bytes:
    """One byte for each code point; what Latin-1 lacks becomes a question mark, which no pattern holds."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,stop:long>>, runs array<struct<start:long,stop:long,step:int,fair:double,band:int,free:boolean>>"


def _scan(s: Settings):
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("step", pa.int32()), ("fair", pa.float64()), ("band", pa.int32()), ("free", pa.bool_())]))
    kinds = [pa.int64()] * 4 + [pa.string(), base_type, runs_type]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), map(_plain, texts), strict=True):
                base = base_spans(text)
                runs = [(a, b, p, fair, band(b - a), all(b <= x or y <= a for x, _, y in base)) for a, b, p, fair in tested(text, s)]
                of = [k for _, k, _ in base]
                rows.append((doc, of.count(0), of.count(1), of.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), [dict(zip(("start", "kind", "stop"), x, strict=True)) for x in base], [dict(zip(("start", "stop", "step", "fair", "band", "free"), x, strict=True)) for x in runs]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def thresholds(counts: list[tuple[int, int, int]], rate: float) -> list[int]:
    """For each band, the least step that counts as a find: Benjamini-Hochberg on (band, step, runs)."""
    out = []
    for i in range(len(BANDS)):
        own = sorted(((step, n) for b, step, n in counts if b == i), reverse=True)
        total, seen, least = sum(n for _, n in own), 0, MOST_STEPS + 1
        for step, n in own:
            seen += n
            if 10 ** (-step / STEPS_PER_TEN) <= rate * seen / total:
                least = step
        out.append(least)
    return out


def _limits(found: DataFrame, s: Settings) -> list[int]:
    runs = found.select(F.explode("runs").alias("r")).groupBy("r.band", "r.step").count()
    return thresholds([(r["band"], r["step"], r["count"]) for r in runs.collect()], s.discovery_rate)  # at most bands x steps rows


def scan_secrets(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document. One pass over the texts; its findings are written, counted and filtered."""
    found = written(id_and_text(docs, id_col, text_col).mapInArrow(_scan(s), _FOUND), "secrets")
    least = F.array(*map(F.lit, _limits(found, s)))
    good = F.filter("runs", lambda r: r["free"] & (r["fair"] >= s.random_level) & (r["step"] >= F.get(least, r["band"])))
    added = F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["stop"].alias("stop")))
    every = F.array_sort(F.concat("base", added))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["stop"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(added).cast("long").alias("n_random"))


def _counted(s: Settings):
    """Only what the false-discovery control needs: how many runs fall on each band and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for _, texts in steps(batches):
            for text in map(_plain, texts):
                for a, b, p, _ in tested(text, s):
                    key = (band(b - a), p)
                    counts[key] = counts.get(key, 0) + 1
        rows = [(b, p, n) for (b, p), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["band", "step", "n"])

    return run


def _redact(s: Settings, limits: list[int], text_col: str, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, text_col):
            out = []
            for raw, there in zip(texts, part.column(text_col).is_valid().to_pylist(), strict=True):
                if not there:
                    out.append(None)
                    continue
                text = _plain(raw)
                spans = [(a, b) for a, _, b in base_spans(text)]
                spans += [(a, b) for a, b, p, fair in candidates(text, s) if fair >= s.random_level and p >= limits[band(b - a)]]
                if not spans:
                    out.append(raw.decode("utf-8", "replace"))
                    continue
                whole, pieces, at = raw.decode("utf-8", "replace"), [], 0
                for a, b in sorted(spans):
                    if a >= at:
                        pieces += [whole[at:a], mark]
                    at = max(at, b)
                out.append("".join([*pieces, whole[at:]]))
            i = part.schema.get_field_index(text_col)
            yield part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type))
        release()

    return run


def redact_secrets(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same rows and columns with every span replaced by `mark`; n_chars, if there and not null, is counted again."""
    counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_counted(s), "band long, step long, n long").groupBy("band", "step").agg(F.sum("n").alias("n"))
    limits = thresholds([(r["band"], r["step"], r["n"]) for r in counts.collect()], s.discovery_rate)  # at most bands x steps rows
    out = docs.mapInArrow(_redact(s, limits, text_col, mark), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out
