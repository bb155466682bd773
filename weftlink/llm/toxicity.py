"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

Labels mark documents, of which only some words are toxic. So the toxic dictionary's content is made of the words that
hold byte 5-grams in far more toxic training documents than others, in front of the ordinary dictionary's, the most
frequent words of ordinary documents. Both compress with the same parameters and the same ordinary content at the same
distance, so a window's two lengths differ by what toxic content saves. The mean and largest difference, and the share
and number of windows over `clear` bytes, are turned into a score by a logistic threshold that is calibrated on documents
of the sample that the dictionaries weren't made from.

zstandard's own trainer isn't used for the contents: it keeps what is frequent in a class, not what tells it apart (the
README has its figures).

Training reads a bounded sample (see labelled_sample); scoring reads every whole text.

Defined results: null and empty texts are one empty window, so they score low; a label other than 0 and 1 isn't learnt
from; a null id is in the held-out fold; repeated rows score alike and count once in training, as do texts of the same
words (the greater label holds); other columns are ignored; without labels of both classes every score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, labelled_sample, remainder, steps

SCHEMA = "doc_id long, score double"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.5
    folds: int = 5
    max_documents: int = 4000
    max_bytes: int = 24 << 20
    #: Words in a window; bytes of a difference that counts as clear.
    window: int = 8
    clear: int = 3
    gram: int = 5
    #: A 5-gram is toxic if this many toxic documents hold it, at this many times the rate of others, with this z-score.
    least_documents: int = 6
    least_ratio: float = 10.0
    least_z: float = 5.0
    #: One document in so many calibrates, if that gives so many of each class.
    calibration: int = 4
    least_calibration: int = 20
    toxic_words: int = 400
    ordinary_words: int = 3000


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _grams(word: bytes, k: int) -> list[bytes]:
    marked = b"<%b>" % word
    return [marked[i : i + k] for i in range(len(marked) - k + 1)]


def distinct(texts: list[bytes], labels: list[int]) -> list[tuple[bytes, int]]:
    """One text and the greatest label of those with the same words, told apart by a hash of all their words."""
    once: dict[bytes, tuple[bytes, int]] = {}
    for text, label in zip(texts, labels, strict=True):
        key = hashlib.sha256(b" ".join(sorted(words_of(text)))).digest()
        first, known = once.get(key, (text, label))
        once[key] = first, max(known, label)
    return list(once.values())


def dictionaries(rows: list[tuple[bytes, int]], s: Settings) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, from texts and labels of both classes."""
    docs, of_gram, total = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for text, label in rows:
        words = words_of(text)
        total[label] += 1
        docs[label].update(words)
        of_gram[label].update({g for w in set(words) for g in _grams(w, s.gram)})
    marks = set()
    for gram, a in of_gram[1].items():
        b = of_gram[0][gram]
        p = (a + b) / (total[0] + total[1])
        z = (a / total[1] - b / total[0]) / math.sqrt(p * (1 - p) * (1 / total[0] + 1 / total[1]) + 1e-12)
        if a >= s.least_documents and z > s.least_z and a / total[1] > s.least_ratio * (b + 0.5) / total[0]:
            marks.add(gram)
    toxic = Counter({w: n for w, n in docs[1].items() if any(g in marks for g in _grams(w, s.gram))})
    ordinary = b" ".join(w for w, _ in reversed(docs[0].most_common(s.ordinary_words)))
    # the most frequent words last: nearer content is cheaper to point at
    return b" ".join(w for w, _ in reversed(toxic.most_common(s.toxic_words))), ordinary


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=4, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    data = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


class Distance:
    """What the toxic dictionary saves over the ordinary one, for each window of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes, s: Settings):
        self.plain, self.marked, self.s = compressor(ordinary), compressor(toxic + b" " + ordinary), s

    def measure(self, text: bytes) -> list[float]:
        words, n = words_of(text), self.s.window
        windows = [b" ".join(words[i : i + n]) for i in range(0, max(1, len(words)), n)]
        plain, marked = self.plain.compress, self.marked.compress
        saved = np.array([len(plain(w)) - len(marked(w)) for w in windows], np.float64)
        clear = saved >= self.s.clear
        return [float(saved.mean()), float(saved.max()), float(clear.mean()), math.log1p(int(clear.sum()))]


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (constant first) of a slightly ridged logistic fit by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w)), z.T @ (y - p) - 1e-3 * w)
    return mean, scale, w


def train(texts: list[bytes], labels: list[int], s: Settings) -> Model:
    """Of each class one document in `calibration` calibrates and the others make the dictionaries; of few, all do both."""
    rows = distinct(texts, labels)
    apart = [[r for r in rows if r[1] == label][:: s.calibration] for label in (0, 1)]
    if min(map(len, apart)) >= s.least_calibration:
        ours = {id(r) for part in apart for r in part}
        learnt, seen = [r for r in rows if id(r) not in ours], [r for part in apart for r in part]
    else:
        learnt = seen = rows
    toxic, ordinary = dictionaries(learnt, s)
    distance = Distance(toxic, ordinary, s)
    fit = calibrate(np.array([distance.measure(t) for t, _ in seen]), np.array([y for _, y in seen], np.float64))
    return Model(toxic, ordinary, *(tuple(map(float, x)) for x in fit))


def scores(texts: list[bytes], model: Model, distance: Distance) -> list[float]:
    x = (np.array([distance.measure(t) for t in texts]) - model.mean) / model.scale
    return (1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))).tolist()


def _score(model: Model, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.toxic, model.ordinary, s)
        for part, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(texts, model, distance), pa.float64())], names=["doc_id", "score"])

    return run


def classify_toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted for every row. One pass over the input without a shuffle, after the sample's."""
    texts, found = labelled_sample(docs, labels, label, s.folds, s.max_documents, s.max_bytes)
    if len({label for _, label in distinct(texts, found)}) < 2:
        share = sum(found) / len(found) if found else 0.5
        scored = id_and_text(docs).select("doc_id", F.lit(share).cast("double").alias("score"))
    else:
        scored = id_and_text(docs).mapInArrow(_score(train(texts, found, s), s), SCHEMA)
    return scored.select("doc_id", (remainder("doc_id", s.folds) == 0).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
