"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output, numpy SGD.

A word contributes its own vector and those of its character n-grams (with word bounds), two neighbours the vector of
their unordered bigram; a document is the average of all, with one constant feature that serves as the prior. Since the output layer
is linear, scoring needs one number for each bucket, the difference of the two classes' logits; the sums are those of the
full model.

Training reads at most `max_documents` labelled rows outside the held-out fold, those of the smallest hashes of their
ids, and of these no more than `max_bytes` of text (none of over an eighth of that). Everything else covers all rows.

Defined results: null or empty texts have the constant feature only, so their score is the prior; a label other than 0
and 1 isn't learnt from; a null id is in the held-out fold (crc32 of the empty text is 0); repeated rows score alike and
count once in training; other columns are ignored; without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VOCAB_ENTRIES, arrow_steps, id_and_text, labelled_sample, mix, ragged, release, remainder
from .segments import Known
from .segments import words as words_of

SCHEMA = "doc_id long, score double"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.3
    folds: int = 5
    max_documents: int = 2000
    max_bytes: int = 16 << 20
    bits: int = 18
    width: int = 8
    shortest: int = 3
    longest: int = 5
    #: Passes over the sample: at least `epochs`, and more over a small one until there are `updates` steps.
    epochs: int = 3
    updates: int = 6000
    rate: float = 0.5
    seed: int = 7


def features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each feature's word (its place in the list) and bucket: the word itself, and its n-grams of characters between bounds; and the words' hashes."""
    room = np.uint64((1 << s.bits) - 1)
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    text = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(words))
    word_of, ends = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
    of, buckets = [np.arange(len(words))], [whole % room]
    for k in range(s.shortest, s.longest + 1):
        first = np.flatnonzero(np.arange(len(text)) + k <= ends)
        gram = np.full(len(first), k, np.uint64)
        for i in range(k):
            gram = mix(gram) + text[first + i]
        of.append(word_of[first])
        buckets.append(mix(gram) % room)
    return np.concatenate(of), np.concatenate(buckets).astype(np.int64) + 1, whole


def bigrams(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """The buckets of a text's neighbouring words: of their hashes' exclusive or, so pairs are unordered and a word beside itself has one bucket."""
    return (mix(hashes[:-1] ^ hashes[1:]) % np.uint64((1 << s.bits) - 1)).astype(np.int64) + 1


def train(texts: list[bytes], labels: list[int], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors and output weights after plain SGD with a linearly falling rate."""
    rng = np.random.default_rng(s.seed)
    inputs = rng.uniform(-1 / s.width, 1 / s.width, (1 << s.bits, s.width)).astype(np.float32)
    outputs = np.zeros((2, s.width), np.float32)
    found, distinct, sizes = words_of(pa.array(texts, pa.large_binary()), lower=False)
    of, buckets, hashes = features(distinct.to_pylist(), s)
    order = np.argsort(of, kind="stable")
    of, buckets = of[order], buckets[order]
    first, docs = np.searchsorted(of, np.arange(len(distinct) + 1)), []
    for words in np.split(found, np.cumsum(sizes)[:-1]):
        unique, times = np.unique(words, return_counts=True)
        each = first[unique + 1] - first[unique]
        pairs = bigrams(hashes[words], s)
        used, where = np.unique(np.concatenate([[0], buckets[ragged(first[unique], each)], pairs]), return_inverse=True)
        share = np.bincount(where, np.concatenate([[1], np.repeat(times, each), np.ones(len(pairs))]))
        docs.append((used, (share / share.sum()).astype(np.float32)))
    epochs = max(s.epochs, -(-s.updates // max(1, len(docs))))
    done, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            used, share = docs[i]
            rate = s.rate * (1 - done / total)
            hidden = share @ inputs[used]
            z = outputs @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ outputs
            outputs -= rate * np.outer(p, hidden)
            inputs[used] -= np.outer(rate * share, back).astype(np.float32)
            done += 1
    return inputs, outputs


def logits(inputs: np.ndarray, outputs: np.ndarray) -> np.ndarray:
    """For each bucket, the difference of the classes' logits."""
    return (inputs.astype(np.float64) @ (outputs[1] - outputs[0]).astype(np.float64)).astype(np.float32)


class Scorer:
    """Scores texts from bucket logits; each distinct word's features are hashed once."""

    def __init__(self, weights: np.ndarray, s: Settings):
        self.weights, self.s = weights, s
        self.clear()

    def clear(self) -> None:
        self.known, self.sums, self.sizes, self.hashes = Known(), np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def score(self, texts: pa.Array) -> list[float]:
        if len(self.known) > VOCAB_ENTRIES:
            self.clear()
        found, distinct, counts = words_of(texts, lower=False)
        numbers, new = self.known.number(distinct)
        if len(new):
            of, buckets, hashes = features(new.to_pylist(), self.s)
            self.sums = np.concatenate([self.sums, np.bincount(of, self.weights[buckets], len(new))])
            self.sizes = np.concatenate([self.sizes, np.bincount(of, minlength=len(new))])
            self.hashes = np.concatenate([self.hashes, hashes])
        of_word, edges = numbers[found], np.append(0, np.cumsum(counts))
        pair = self.weights[bigrams(self.hashes[of_word], self.s)] if len(of_word) else np.zeros(0)
        last = edges[1:-1] - 1  # no bigram goes from one text into the next
        pair[last[(last >= 0) & (last < len(pair))]] = 0
        add = lambda x: np.diff(np.append(0, np.cumsum(x))[edges])
        z = float(self.weights[0]) + add(self.sums[of_word]) + add(np.append(pair, 0)[: len(of_word)])
        n = 1 + add(self.sizes[of_word]) + np.maximum(counts - 1, 0)
        return (1 / (1 + np.exp(-np.clip(z / n, -500, 500)))).tolist()


def _score(weights: np.ndarray, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, s)
        for part, texts in arrow_steps(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scorer.score(texts), pa.float64())], names=["doc_id", "score"])
        release()

    return run


def classify_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row. One pass over the input without a shuffle, after the sample's."""
    texts, found = labelled_sample(docs, labels, label, s.folds, s.max_documents, s.max_bytes)
    if len(set(found)) < 2:
        share = sum(found) / len(found) if found else 0.5
        scored = id_and_text(docs).select("doc_id", F.lit(share).cast("double").alias("score"))
    else:
        scored = id_and_text(docs).mapInArrow(_score(logits(*train(texts, found, s)), s), SCHEMA)
    return scored.select("doc_id", (remainder("doc_id", s.folds) == 0).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
