"""Collocations against a count of every run."""

import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlink.llm import collocations as module
from weftlink.llm.collocations import _ascii_lower, collocations, numbered

SCHEMA = "doc_id long, lang string, text string, phrase string, f long"


def brute(docs, max_n, least, share, top):
    found, total = Counter(), Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                for i in range(len(w) - n + 1):
                    found[lang, tuple(w[i : i + n])] += 1
    rows = []
    candidates = {k: a for k, a in found.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        within = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
        if any(x == lang and len(q) > len(p) and within(q) and 100 * f >= share * a for (x, q), f in candidates.items()):
            continue
        cuts = [(int(Fraction(2000000 * a, found[lang, p[:k]] + found[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, " ".join(p), a, found[lang, p[:k]], found[lang, p[k:]], total[lang], score))
    out = []
    for lang in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return out


@pytest.mark.parametrize("max_n,least,top", [(4, 3, 2000), (3, 2, 5), (5, 4, 40)])
def test_against_brute_force(spark, max_n, least, top):
    rng = random.Random(max_n)
    words = ["a", "B", "über", "ÜBER", "New", "york", "City", "x y", "日本"]
    docs = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    docs += [("en", None), (None, ""), ("en", " .,;\n"), ("en", "New York City " * 2000), ("de", "a"), *docs[:3]]
    df = spark.createDataFrame([(i, g, t, "clash", 1) for i, (g, t) in enumerate(docs)], SCHEMA)
    got = collocations(df, max_n=max_n, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute(docs, max_n, least, 80, top)
    assert expected and sorted(map(tuple, got.collect())) == sorted(expected)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_ascii_is_lowered(spark):
    """Every character beside a capital of A-Z, so that both ways are met."""
    every = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").selectExpr("concat('Ab', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'Z') AS t")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert every.count() > 1_000_000
    assert every.where(_ascii_lower(F.col("t")) != F.translate("t", capitals, capitals.lower())).count() == 0


def test_words_of_chunks():
    texts = [None, "", " .\t,", "Ab\x0bÜ,x", "ab  Ab\ty", "日本. x"]
    stream, words = numbered(pa.array([(t or "").encode() for t in texts], pa.large_binary()))
    named = [b"", *words.to_pylist()]
    assert [named[i].decode() for i in stream] == ["", "ab", "", "Ü", "", "x", "", "ab", "ab", "y", "", "日本", "", "x"]


def test_no_result_rests_on_a_filter(spark, monkeypatch):
    """Filters of 64 bits let nearly all runs pass."""
    monkeypatch.setattr(module, "FILTER_WORDS", (1, 1))
    rng = random.Random(9)
    docs = [(rng.choice(["en", None]), " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(40))) for _ in range(40)]
    df = spark.createDataFrame([(i, g, t, "clash", 1) for i, (g, t) in enumerate(docs)], SCHEMA)
    expected = brute(docs, 4, 3, 80, 2000)
    assert expected and sorted(map(tuple, collocations(df, least=3).collect())) == sorted(expected)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_phrases_of_several_chunks_are_added_up_in_the_task(monkeypatch, most):
    monkeypatch.setattr(module, "CHUNK_BYTES", 1)
    texts = [("en", "a b a c"), ("de", "a d"), ("en", "a b"), ("en", "e a")]
    chunks = [c for t in texts for c in module._chunks(iter([pa.RecordBatch.from_pylist([dict(zip(("lang", "text"), t, strict=True))])]))]
    got = [tuple(r.values()) for b in module._phrases([], most)(iter(chunks)) for r in b.to_pylist()]
    sums = Counter()
    for lang, n, phrase, f in got:
        sums[lang, n, phrase] += f
    assert sums == Counter({("en", 1, "a"): 4, ("en", 1, "b"): 2, ("en", 1, "c"): 1, ("en", 1, "e"): 1, ("de", 1, "a"): 1, ("de", 1, "d"): 1})
    assert most == 1 or len(got) == len(sums)
