"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

from weftlink.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
SPACE = " \t\n\x0b\x0c\r"
STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit, messages) of (role, text, fault) rows, by a best-first search over (cost, audit)."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in STEP[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                late = 3 if fault == "truncated" else 0
                if role[:1] in STEP[state]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, STEP[state][role[:1]], (*out, (role, text))))
                for other in ("user", "assistant"):
                    if other[0] in STEP[state]:
                        heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, other[0], (*out, (other, text))))


def brute(table, damage=True):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        groups[conv]  # noqa: B018
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            groups[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort()
        seen, judged = set(), []
        for _, _, role, text in rows:
            body = text.strip(SPACE)
            judged.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for known, t, *_ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda f: sum(x[2] == f for x in judged)  # noqa: E731,B023
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(judged, judged[1:]))
        cost, audit, messages = cheapest(judged)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha))
    return out


def table(seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u2"]
    texts = ["Hi.", "Well!", "cut off", "", " \n", None, "日本。", "why?", "a" * 5000 + "."]
    rows = []
    for conv in [None, *range(120)]:
        start = rng.choice([0, -4, 10**12])
        for k in range(rng.randrange(9)):
            turn = rng.choice([start + k, start + k, start + k, start + k * 3, None])
            role = roles[k % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(50)}."))
    rows += rows[5:9] + [(500, 0, "user", "Repeated.")] * 4 + [(501, -(2**63), "user", "far."), (501, 2**63 - 1, "assistant", "apart.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def key(r):
    return r[0] is not None, r[0] or 0


def test_against_brute_force(spark):
    rows = table()
    got = C.summaries(C.damaged(frame(spark, rows)))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    expected = [(r[0], min(r[1], 2**63 - 1), *r[2:]) for r in brute(rows)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_messages_make_up_the_digest(spark):
    rows = [r for r in table(2) if r[0] != 501]
    whole = frame(spark, rows)
    found = defaultdict(list)
    for r in C.repair(whole).orderBy("conv_id", "place").collect():
        found[r.conv_id].append(f"{r.role}:{r.text}")
    for r in C.summaries(whole).collect():
        assert hashlib.sha256("\n".join(found[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
    assert sorted(map(tuple, C.summaries(whole).collect()), key=key) == sorted(brute(rows, damage=False), key=key)


def test_long_conversation_in_chunks(spark, monkeypatch):
    rows = [(1, i, "user" if i % 3 else "assistant", f"{'word ' * 300}{i}.") for i in range(3000)] + [(2, 0, "user", "x" * 3_000_000), (2, 1, "assistant", "y.")]
    assert sorted(map(tuple, C.summaries(frame(spark, rows)).collect()), key=key) == sorted(brute(rows, damage=False), key=key)


def test_shared_prefixes_are_computed_once():
    trie = C.Trie()
    for signature in sorted(["uaua", "uauaU", "uax", "ua", "ua-"]):
        trie.insert(signature)
    assert trie.computed == len({s[:k] for s in ["uaua", "uauaU", "uax", "ua", "ua-"] for k in range(1, len(s) + 1)})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.summaries(C.damaged(empty)).collect() == [] and C.repair(empty).collect() == []
