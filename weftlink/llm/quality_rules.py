"""Quality rules: counts of words, symbols and repetition, and the fertility of public tokenisers.

Each distinct word is encoded once with every vocabulary: SentencePiece models that fall back to bytes, and byte-level BPE
ranks, whose single bytes of longer characters count as fallbacks. A document is measured, for each vocabulary, by
characters per token, the share of tokens that are byte fallbacks, and the entropy of its tokens over the greatest that
their number allows. Bands of these are fitted for each script: from all documents of the input that pass the base rule,
what lies beyond the `tail` quantiles at either end (for byte fallbacks at the upper) is rejected; exact quantiles at
every size, so of a few documents all are inside. The fixed bands of `Rules` judge documents without letters, and a
script without any document to fit to.

Counts are exact: bands come from histograms whose size is bounded by scripts, measures and bins.

Defined results: a null text counts as empty; an empty text has zero counts, no fertility (nulls) and fails the base
rule; a null id stays null; repeated rows are judged one by one; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_steps, id_and_text, mix, ragged, release, shingles, written
from .segments import Known, binary, content
from .segments import words as words_of

#: Words that a worker remembers before it starts anew.
WORDS = 700_000
MEASURES = ("chars", "bytes", "entropy")
#: Bins of a measure's unit, and the greatest value that has a bin of its own.
BINS, GREATEST = 400, 20


def _bands() -> dict[str, tuple[tuple[float, float], tuple[float, float], tuple[float, float]]]:
    """For each script the ranges of characters per token, byte share and relative entropy where none are fitted."""
    return {
        "latin": ((1.15, 8.0), (0, 0.25), (0.3, 1)),
        "greek": ((0.6, 6.0), (0, 0.6), (0.2, 1)),
        "cyrillic": ((0.6, 7.0), (0, 0.6), (0.2, 1)),
        "semitic": ((0.4, 6.0), (0, 0.8), (0.2, 1)),
        "east_asian": ((0.2, 4.0), (0, 0.95), (0.2, 1)),
        "other": ((0.2, 8.0), (0, 0.95), (0.2, 1)),
        "none": ((1.15, 8.0), (0, 0.25), (0.3, 1)),
    }


@dataclass(frozen=True)
class Rules:
    #: Names and files of vocabularies: *.model for SentencePiece, *.tiktoken for byte-level BPE ranks.
    vocabularies: dict[str, str]
    min_words: int = 10
    max_repeat_percent: int = 20
    tail: float = 0.0005
    bands: dict = field(default_factory=_bands)

    def schema(self) -> str:
        own = "".join(f", {v}_tokens long" + "".join(f", {v}_{m} double" for m in MEASURES) for v in self.vocabularies)
        return "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string" + own


#: Scripts by the first byte of a letter's UTF-8 form; ASCII letters and C3-CA are Latin.
_LEADS = {"latin": range(0xC3, 0xCB), "greek": range(0xCD, 0xD0), "cyrillic": range(0xD0, 0xD5), "semitic": range(0xD7, 0xDC), "east_asian": range(0xE2, 0xEE)}
_LEADS["other"] = [*range(0xD5, 0xD7), *range(0xDC, 0xE2), *range(0xEE, 0xF5)]
_LEADS["latin"] = [*range(65, 91), *range(97, 123), *_LEADS["latin"]]
SCRIPTS = [*_LEADS, "none"]
_SCRIPT = np.full(256, len(_LEADS), np.uint8)
for _i, _leads in enumerate(_LEADS.values()):
    _SCRIPT[list(_leads)] = _i
_SYMBOL, _SOLID, _START = np.zeros(256, bool), np.ones(256, bool), np.ones(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SOLID[[32, *range(9, 14)]] = False
_START[0x80:0xC0] = False


def _per(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks, or their sum, between the places `at`."""
    return np.diff(np.append(0, np.cumsum(marks, dtype=np.int64))[at])


def scripts_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each text's script in SCRIPTS: the one with the most letters, judged by lead bytes; ties go to the first."""
    of = _SCRIPT[raw]
    counts = np.array([_per(of == i, at) for i in range(len(SCRIPTS) - 1)])
    return np.where(counts.any(axis=0), counts.argmax(axis=0), len(SCRIPTS) - 1)


def repeated_words(hashes: np.ndarray, edges: np.ndarray, k: int = 5) -> np.ndarray:
    """For texts of words between the edges: words inside k-word windows that occur at least twice in the text."""
    n = len(hashes)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    windows = shingles(hashes, k)
    inside = np.flatnonzero(text[: len(windows)] == text[n - len(windows) :]) if len(windows) else np.empty(0, np.int64)
    keys = mix(windows[inside] + text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    edge[inside[twice]] += 1
    np.subtract.at(edge, inside[twice] + k, 1)
    return _per(np.cumsum(edge)[:-1] > 0, edges)


def duplicate_lines(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text its lines with a word that equal an earlier one."""
    if not len(raw):
        return np.zeros(len(at) - 1, np.int64)
    ends = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([at[:-1], ends + 1]))
    starts = starts[starts < len(raw)]
    lines = binary(raw, np.append(starts, len(raw)))
    # a line's end isn't part of it
    has_end = raw[np.append(starts[1:], len(raw)) - 1] == 10
    with_word = _per(_SOLID[raw], np.append(starts, len(raw))) > 0
    lines = pc.binary_slice(lines.filter(pa.array(with_word & has_end)), 0, -1), lines.filter(pa.array(with_word & ~has_end))
    text = np.searchsorted(at, starts, side="right") - 1
    texts = np.concatenate([text[with_word & has_end], text[with_word & ~has_end]])
    coded = pc.dictionary_encode(pa.concat_arrays(lines))
    distinct = np.unique(texts * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False)) // (len(coded.dictionary) + 1)
    return np.bincount(texts, minlength=len(at) - 1) - np.bincount(distinct, minlength=len(at) - 1)


class Vocabulary:
    """Token ids of numbered words in flat arrays."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.fromiter(map(model.is_byte, range(model.get_piece_size())), bool)
            self.encode = lambda words: model.encode(words, num_threads=1)
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.is_byte[[i for b, i in ranks.items() if len(b) == 1 and b >= b"\x80"]] = True
            self.encode = lambda words: [model.encode_ordinary(" " + w) for w in words]
        self.clear()

    def clear(self) -> None:
        self.sizes, self.starts, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def learn(self, words: list[str]) -> None:
        found = self.encode(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])

    def measure(self, words: np.ndarray, edges: np.ndarray, chars: np.ndarray) -> list[np.ndarray]:
        """Tokens of each text, and the measures; not numbers where there is no token."""
        sizes = self.sizes[words]
        tokens = self.flat[ragged(self.starts[words], sizes)].astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))[edges]
        n, of_bytes = np.diff(ends), _per(self.is_byte[tokens], ends)
        keys = np.sort(np.repeat(np.arange(len(n)), n) * len(self.is_byte) + tokens)
        firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        counts, text = np.diff(np.append(firsts, len(keys))), keys[firsts] // len(self.is_byte)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = counts / n[text]
            bits = np.bincount(text, -p * np.log2(p), len(n))
            most = np.log2(n)
            return [n, chars / n, of_bytes / n, np.where(n > 1, np.minimum(bits / most, 1), np.where(n == 1, 1.0, np.nan))]


def _judged(batches: Iterator[pa.RecordBatch], rules: Rules, id_col: str, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Each step's rows and their measures, in the schema's order."""
    known, vocabularies = Known(), [Vocabulary(x) for x in rules.vocabularies.values()]
    for part, texts in arrow_steps(batches, text_col):
        if len(known) > WORDS:
            known.clear()
            for v in vocabularies:
                v.clear()
        found, distinct, counts = words_of(texts, lower=False)
        numbers, new = known.number(distinct)
        if len(new):
            plain = [w.decode("utf-8", "replace") for w in new.to_pylist()]
            for v in vocabularies:
                v.learn(plain)
        raw, at = content(texts)
        words, edges = numbers[found], np.append(0, np.cumsum(counts))
        chars = _per(_SOLID[raw] & _START[raw], at)
        repeated = repeated_words(mix(words.astype(np.uint64)), edges)
        failed = (counts < rules.min_words) | (100 * repeated > rules.max_repeat_percent * counts)
        columns = [part.column(id_col).cast(pa.int64()), *map(pa.array, (counts, chars, _per(_SYMBOL[raw], at), duplicate_lines(raw, at), repeated, failed))]
        columns.append(pa.array(SCRIPTS).take(pa.array(scripts_of(raw, at))))
        for v in vocabularies:
            n, *measures = v.measure(words, edges, chars)
            columns += [pa.array(n), *(pa.array(m, pa.float64(), mask=n == 0) for m in measures)]
        yield part, columns
    del known, vocabularies
    release()


def _names(rules: Rules) -> list[str]:
    return [x.split()[0] for x in rules.schema().split(", ")]


def _measure(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, columns in _judged(batches, rules, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays(columns, names=_names(rules))

    return run


def _bin(value: Column) -> Column:
    return F.least(F.round(value * BINS), F.lit(BINS * GREATEST)).cast("long")


def fitted(measured: DataFrame, rules: Rules) -> dict[str, list[tuple[int, int]]]:
    """For each script the lowest and highest accepted bin of each vocabulary's measures, from all documents that pass the base rule."""
    columns = [f"{v}_{m}" for v in rules.vocabularies for m in MEASURES]
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _bin(F.col(c)).alias("bin")) for i, c in enumerate(columns)]))
    counts = measured.where("not base_failed").select("script", values.alias("x")).where("x.bin is not null").groupBy("script", "x.i", "x.bin").count()
    seen: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts.collect():  # at most scripts x measures x bins rows
        seen.setdefault((r["script"], r["i"]), {})[r["bin"]] = r["count"]
    out = {}
    for script in SCRIPTS:
        out[script] = []
        for i, column in enumerate(columns):
            low, high = rules.bands[script][MEASURES.index(column.rsplit("_", 1)[1])]
            bins = sorted(seen.get((script, i), {}).items())
            total = sum(n for _, n in bins)
            if total and script != "none":
                ends = np.cumsum([n for _, n in bins])
                out[script].append((0 if column.endswith("_bytes") else bins[int(np.searchsorted(ends, rules.tail * total, side="right"))][0], bins[int(np.searchsorted(ends, (1 - rules.tail) * total))][0]))
            else:
                out[script].append((round(low * BINS), round(high * BINS)))
    return out


def _fits(bands: dict[str, list[tuple[int, int]]], rules: Rules) -> Column:
    """Whether a measured document passes the base rule and lies in its script's bands."""
    columns = [f"{v}_{m}" for v in rules.vocabularies for m in MEASURES]
    verdict = F.lit(False)
    for script, ranges in bands.items():
        inside = [_bin(F.col(c)).between(low, high) for c, (low, high) in zip(columns, ranges, strict=True)]
        verdict = F.when(F.col("script") == script, _all(inside)).otherwise(verdict)
    return ~F.col("base_failed") & F.coalesce(verdict, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def quality_rules(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, fertility and verdicts. One pass over the texts; the measures are written, then judged."""
    measured = written(id_and_text(docs, id_col, text_col).mapInArrow(_measure(rules), rules.schema()), "measures")
    names = _names(rules)
    return measured.select(*names[:7], _fits(fitted(measured, rules), rules).alias("kept"), *names[7:])


def _with_measures(rules: Rules, id_col: str, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in _judged(batches, rules, id_col, text_col):
            yield part.append_column(name, pa.StructArray.from_arrays(columns, names=_names(rules)))

    return run


def well_formed(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that the rules keep, with all their columns. They are written once with their measures."""
    name = "_measures"
    while name in docs.columns:
        name += "_"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {name} struct<{rules.schema().replace(' ', ':').replace(',:', ', ')}>"
    measured = written(docs.mapInArrow(_with_measures(rules, id_col, text_col, name), schema), "measured")
    own = measured.select(f"{name}.*")
    bands = fitted(own, rules)
    inner = measured.select(F.struct(*map(_quoted, docs.columns)).alias("_row"), f"{name}.*")
    return inner.where(_fits(bands, rules)).select("_row.*")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
