"""Queries of generated sources, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.generators.weak import WeakPolicy, weakened
from weftlink.plans import oracle as O
from weftlink.plans.entities import sources
from weftlink.queries import query

POLICY = WeakPolicy(seed=5051)


def _n(h: str, i: int, n: int) -> str:
    return f"CAST(('0x' || substr({h}, {i}, {n})) AS UBIGINT)"


def _side(s: str) -> str:
    h = lambda f: f"sha256('{POLICY.seed}:{s}:' || row_id || ':{f}')"
    places = lambda t, p: f"list_filter(range(1, length({t}) + 1), lambda i: regexp_matches(substr({t}, i, 1), '{p}'))"
    pick = lambda ps, hh: f"{ps}[CAST({_n(hh, 1, 4)} % nullif(len({ps}), 0) AS BIGINT) + 1]"
    stale = f"'{'https://' if s == 'A' else ''}legacy-' || substr(wh, 1, 12) || '.invalid'"
    host = "regexp_replace(lower(regexp_extract(CASE WHEN contains(website, '://') THEN website ELSE '//' || website END, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
    style = f"'https://www.' || {host} || '/directory'" if s == "A" else f"'www.' || {host}"
    unit = lambda x: f"CAST({_n(x, 1, 16)} AS DOUBLE) / 18446744073709551616.0"
    return f"""SELECT '{s}' AS side, row_id, p2 AS phone, e2 AS email, w2 AS website, list_filter([
      CASE WHEN p2 <> phone THEN 'phone:' || CASE WHEN pu < 0.45 THEN 'weak_policy_missing' ELSE 'weak_policy_digit_corruption' END || ':' || phone || '>' || p2 END,
      CASE WHEN e2 <> email THEN 'email:' || CASE WHEN eu < 0.45 THEN 'weak_policy_missing' ELSE 'weak_policy_typo' END || ':' || email || '>' || e2 END,
      CASE WHEN w2 <> website THEN 'website_domain:' || CASE WHEN wu < 0.45 THEN 'weak_policy_missing' WHEN wu < 0.85 THEN 'weak_policy_stale' ELSE 'weak_policy_format' END || ':' || website || '>' || w2 END], lambda x: x IS NOT NULL) AS ev
    FROM (SELECT *, CASE WHEN phone = '' OR pu < 0.45 THEN '' WHEN pu < 0.85 AND pp IS NOT NULL THEN substr(phone, 1, pp - 1) || CAST((CAST(substr(phone, pp, 1) AS BIGINT) + 1 + {_n('ph', 5, 2)} % 8) % 10 AS VARCHAR) || substr(phone, pp + 1) ELSE phone END AS p2,
        CASE WHEN email = '' OR eu < 0.45 THEN '' WHEN eu < 0.85 AND ep IS NOT NULL THEN split_part(email, '@', 1) || '@' || substr(dom, 1, ep - 1) || chr(CAST((ord(lower(substr(dom, ep, 1))) - 97 + 1 + CAST({_n('eh', 5, 2)} AS BIGINT) % 24) % 26 + 97 AS INTEGER)) || substr(dom, ep + 1) ELSE email END AS e2,
        CASE WHEN website = '' OR wu < 0.45 THEN '' WHEN wu < 0.85 THEN {stale} WHEN wu < 0.95 THEN {style} ELSE website END AS w2
      FROM (SELECT *, {pick(places('phone', '[0-9]'), 'ph')} AS pp, {pick(places('dom', '[A-Za-z]'), 'eh')} AS ep, {unit('ph')} AS pu, {unit('eh')} AS eu, {unit('wh')} AS wu
        FROM (SELECT row_id, phone, email, website, split_part(email, '@', 2) AS dom, {h('phone')} AS ph, {h('email')} AS eh, {h('website_domain')} AS wh FROM {s.lower()}_src)))"""


@query("gen04_weak_identifiers", f"{O.chain('sources')} SELECT side, row_id, phone, email, website, array_to_string(ev, ' ') AS events FROM ({_side('A')} UNION ALL {_side('B')})")
def gen04_weak_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = lambda e: F.concat(e["field"], F.lit(":"), e["strategy"], F.lit(":"), e["before"], F.lit(">"), e["after"])
    one = lambda df, s: weakened(df, s, POLICY, "row_id").select(F.lit(s).alias("side"), "row_id", "phone", "email", "website", F.array_join(F.transform("events", event), " ").alias("events"))
    a, b = sources(spark, sf_dir)
    return one(a, "A").union(one(b, "B"))
