"""Weak identifiers against the same draws in Python."""

import hashlib
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from weftlink.generators.weak import WeakPolicy, digest, draw, weakened
from weftlink.plans.model import Invalid


def test_draws_are_python_s(spark):
    ids = [f"r{i}" for i in range(300)]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", draw(digest(7, "A", F.col("id"), "phone")).alias("d")).collect()
    for r in got:
        assert r.d == int.from_bytes(hashlib.sha256(f"7:A:{r.id}:phone".encode()).digest()[:8], "big") / 2**64


def brute(policy, side, row_id, phone, email, website):
    of = lambda f: hashlib.sha256(f"{policy.seed}:{side}:{row_id}:{f}".encode()).digest()
    unit = lambda h: int.from_bytes(h[:8], "big") / 2**64
    events, out = [], []
    for field, v in (("phone", phone), ("email", email), ("website_domain", website)):
        h, v = of(field), v or ""
        u, pick = unit(h), int.from_bytes(h[:2], "big")
        w, name = v, None
        if v and u < 0.45:
            w, name = "", "weak_policy_missing"
        elif v and u < 0.85:
            if field == "phone" and (at := [i for i, c in enumerate(v) if c in "0123456789"]):
                i = at[pick % len(at)]
                w, name = v[:i] + str((int(v[i]) + 1 + h[2] % 8) % 10) + v[i + 1 :], "weak_policy_digit_corruption"
            elif field == "email" and v.count("@") == 1:
                local, host = v.split("@")
                if at := [i for i, c in enumerate(host) if c.isascii() and c.isalpha()]:
                    i = at[pick % len(at)]
                    w, name = f"{local}@{host[:i]}{chr((ord(host[i].lower()) - 97 + 1 + h[2] % 24) % 26 + 97)}{host[i + 1 :]}", "weak_policy_typo"
            elif field == "website_domain":
                w, name = ("https://" if side == "A" else "") + f"legacy-{h.hex()[:12]}.invalid", "weak_policy_stale"
        elif v and u < 0.95 and field == "website_domain" and (host := (urlsplit(v if "://" in v else f"//{v}").hostname or "").removeprefix("www.")):
            w, name = (f"https://www.{host}/directory" if side == "A" else f"www.{host}"), "weak_policy_format"
        if w != v:
            events.append((field, name, v, w))
        out.append(w)
    return (row_id, *out, events)


@pytest.mark.parametrize("side", ["A", "B"])
def test_rows_against_brute_force(spark, side):
    values = [("(555) 010-2345", "Me@Host.Example.com", "https://www.Host.example/x"), ("none", "two@at@signs", "host.example"), ("", "a@1.2", ""), (None, None, None), ("5", "x@Z", "HTTP://U@h.example:80"), ("x1y", "@b.c", "a b")]
    rows = [(f"{side}{i}", *values[i % len(values)], "clash") for i in range(240)]
    policy = WeakPolicy(seed=11)
    got = weakened(spark.createDataFrame(rows, "id string, phone string, email string, website string, other string").repartition(3), side, policy, "id")
    found = sorted((r.id, r.phone, r.email, r.website, [tuple(e) for e in r.events]) for r in got.collect())
    assert found == sorted(brute(policy, side, *r[:4]) for r in rows) and {e[1] for r in found for e in r[4]} == {"weak_policy_missing", "weak_policy_digit_corruption", "weak_policy_typo", "weak_policy_stale", "weak_policy_format"}


def test_rates_that_exclude_each_other_are_checked():
    for wrong in ({"phone_missing": 0.7}, {"seed": -1}, {"domain_format": 0.2}, {"email_typo": -0.1}):
        with pytest.raises(Invalid):
            WeakPolicy(**({"seed": 1} | wrong))
