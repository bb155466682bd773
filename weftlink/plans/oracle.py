"""The same match as DuckDB SQL, written separately from the DataFrame plan, for comparing results."""

from __future__ import annotations

from collections.abc import Sequence

from .entities import MAPPINGS, side_sql
from .model import CONFLICTS, STOP_TOKENS, WEIGHTS, Mapping

_ENDINGS = "co|company|corp|corporation|inc|incorporated|llc|ltd|limited"


def text(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def name(c: str) -> str:
    return f"trim(regexp_replace({text(c)}, '(?:(?:^| )(?:{_ENDINGS}))+$', ''))"


def phone(c: str) -> str:
    d = f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"
    d = f"(CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END)"
    return f"(CASE WHEN length({d}) < 7 THEN '' ELSE {d} END)"


def domain(c: str) -> str:
    low = f"trim(lower(coalesce({c}, '')))"
    host = f"regexp_extract(CASE WHEN contains({low}, '://') THEN {low} ELSE '//' || {low} END, '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)', 1)"
    host = f"regexp_replace(regexp_replace({host}, '\\.+$', ''), '^www\\.', '')"
    return f"(CASE WHEN contains({host}, '.') AND NOT contains({host}, ' ') THEN {host} ELSE '' END)"


def email(c: str) -> str:
    e = f"regexp_replace(lower(coalesce({c}, '')), '\\s+', '', 'g')"
    return f"(CASE WHEN len(string_split({e}, '@')) = 2 AND split_part({e}, '@', 1) <> '' AND {domain(f'split_part({e}, chr(64), 2)')} <> '' THEN {e} ELSE '' END)"


def address(c: str) -> str:
    out = text(c)
    words = {"avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "street": "st"}
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items())
    return f"array_to_string(list_transform(string_split({out}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"


def number_of(c: str) -> str:
    return f"regexp_extract({c}, '^([0-9]+)(?: |$)', 1)"


def postal(c: str) -> str:
    p = f"regexp_replace({text(c)}, '[^a-z0-9]', '', 'g')"
    return f"(CASE WHEN regexp_matches({p}, '^[0-9]{{5}}') THEN substr({p}, 1, 5) ELSE {p} END)"


def of_kind(kind: str, c: str) -> str:
    return {"name_or_title": name, "contact_person": name, "address": address, "email": email, "phone": phone, "domain": domain, "postal": postal}.get(kind, text)(c)


def meaningful(c: str) -> str:
    stop = ", ".join(f"'{t}'" for t in STOP_TOKENS)
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({stop})))"


def compact(c: str) -> str:
    return f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def prepared(mappings: Sequence[Mapping] = MAPPINGS) -> str:
    """CTEs a_src, b_src and a, b with v_ and n_ columns."""
    out = []
    for side in "AB":
        s = side.lower()
        columns = ", ".join(f"coalesce({m.a_column if side == 'A' else m.b_column}, '') AS v_{m.mapping_id}, {of_kind(m.kind, m.a_column if side == 'A' else m.b_column)} AS n_{m.mapping_id}" for m in mappings)
        out += [f"{s}_src AS MATERIALIZED ({side_sql(side)})", f"{s} AS MATERIALIZED (SELECT row_id, {columns} FROM {s}_src)"]
    return ", ".join(out)


def keys(side: str, mappings: Sequence[Mapping] = MAPPINGS) -> str:
    """Distinct (row_id, blocker_id, key) of one side."""
    selects = []
    add = lambda blocker, key, where: selects.append(f"SELECT row_id, '{blocker}' AS blocker_id, {key} AS key FROM {side} WHERE {where}")
    many = lambda blocker, keys: selects.append(f"SELECT row_id, '{blocker}' AS blocker_id, unnest({keys}) AS key FROM {side}")
    by = lambda *kinds: [f"n_{m.mapping_id}" for m in mappings if m.kind in kinds]
    for m in mappings:
        n, i = f"n_{m.mapping_id}", m.mapping_id
        if m.kind == "persistent_identifier":
            add("persistent_exact_v1", f"'{i}:identifier:' || {n}", f"{n} <> ''")
        if m.kind in ("categorical", "numeric", "date_or_timestamp", "free_text", "unknown"):
            add("exact_supporting_v1", f"'{i}:supporting:' || {n}", f"{n} <> ''")
        if m.kind in ("phone", "email", "domain"):
            add("exact_strong_v1", f"'{i}:{m.kind}:' || {n}", f"{n} <> ''")
        if m.kind == "email":
            add("exact_strong_v1", f"'{i}:email-domain:' || split_part({n}, '@', 2)", f"{n} <> ''")
        if m.kind == "contact_person":
            for place in by("geography"):
                add("supporting_context_v1", f"'{i}:' || {n} || ':location:geography:' || {place}", f"{n} <> '' AND {place} <> ''")
            for at in by("address"):
                add("supporting_context_v1", f"'{i}:' || {n} || ':number:' || {number_of(at)}", f"{n} <> '' AND {number_of(at)} <> ''")
    for n in by("name_or_title"):
        t, c = meaningful(n), compact(n)
        many("name_token_v1", f"list_transform({t}, lambda t: 'token:' || t)")
        add("name_character_v1", f"'prefix:' || substr({c}, 1, 4)", f"length({c}) >= 4")
        many("name_character_v1", f"list_transform(list_filter({t}, lambda t: length(t) >= 4), lambda t: 'token-prefix:' || substr(t, 1, 4))")
        for place in by("geography"):
            many("location_name_v2", f"list_transform(CASE WHEN {place} = '' THEN [] ELSE {t} END, lambda t: 'geography:' || {place} || ':token:' || t)")
            add("location_name_v2", f"'geography:' || {place} || ':compact-name:' || {c}", f"{place} <> '' AND {c} <> ''")
        for at in by("address"):
            many("address_name_v2", f"list_transform(CASE WHEN {number_of(at)} = '' THEN [] ELSE {t} END, lambda t: 'number:' || {number_of(at)} || ':token:' || t)")
            add("address_name_v2", f"'number:' || {number_of(at)} || ':compact-name:' || {c}", f"{number_of(at)} <> '' AND {c} <> ''")
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(selects) + ")"


BLOCKING = f"""
ka AS MATERIALIZED ({keys("a")}), kb AS MATERIALIZED ({keys("b")}),
buckets AS MATERIALIZED (
  SELECT *, n_a > 20 OR n_b > 20 OR n_a * n_b > 100 AS suppressed
  FROM (SELECT blocker_id, key, count(*) AS n_a FROM ka GROUP BY ALL) x JOIN (SELECT blocker_id, key, count(*) AS n_b FROM kb GROUP BY ALL) y USING (blocker_id, key)),
related AS MATERIALIZED (
  SELECT ka.row_id AS a_row_id, kb.row_id AS b_row_id, blocker_id, substr(sha256(key), 1, 16) AS key_hash
  FROM ka JOIN buckets USING (blocker_id, key) JOIN kb USING (blocker_id, key) WHERE NOT suppressed),
pairs AS MATERIALIZED (
  SELECT a_row_id, b_row_id, 'candidate-' || substr(sha256(a_row_id || chr(0) || b_row_id), 1, 20) AS candidate_id,
         string_agg(DISTINCT blocker_id || ':' || key_hash, ',' ORDER BY blocker_id || ':' || key_hash) AS evidence
  FROM related GROUP BY ALL)
"""


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda t: t <> ''))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({_tokens(a)}, {_tokens(b)}))"
    return six(f"{both} / (len({_tokens(a)}) + len({_tokens(b)}) - {both})")


def _overlap(a: str, b: str) -> str:
    return six(f"len(list_intersect({_tokens(a)}, {_tokens(b)})) / least(len({_tokens(a)}), len({_tokens(b)}))")


def six(x: str) -> str:
    """Six places, half to even on the double's own value, through its exact decimal text."""
    return f"CAST(printf('%.6f', CAST({x} AS DOUBLE)) AS DOUBLE)"


#: Character ratios of distinct, unequal, non-empty pairs: the longest common block, then its two sides, again and again.
#: Blocks are runs of equal characters on one diagonal, so only the meeting characters of a pair are listed.
RATIOS = f"""
wanted AS MATERIALIZED (SELECT row_number() OVER () AS id, l, r FROM (SELECT DISTINCT x AS l, y AS r FROM ratio_in WHERE x <> y AND x <> '' AND y <> '')),
seg(id, l, r, size) AS (
  SELECT id, l, r, 0 FROM wanted
  UNION ALL
  SELECT id, unnest([substr(l, 1, i - 1), substr(l, i + k)]), unnest([substr(r, 1, j - 1), substr(r, j + k)]), unnest([k, 0])
  FROM (
    WITH cut AS (SELECT row_number() OVER () AS no, id, l, r FROM seg WHERE l <> '' AND r <> ''),
    x AS (SELECT no, unnest(string_split(l, '')) AS c, unnest(range(1, length(l) + 1)) AS i FROM cut),
    y AS (SELECT no, unnest(string_split(r, '')) AS c, unnest(range(1, length(r) + 1)) AS j FROM cut),
    met AS (SELECT no, i, j, i - row_number() OVER (PARTITION BY no, i - j ORDER BY i) AS run FROM x JOIN y USING (no, c)),
    runs AS (SELECT no, min(i) AS i, min(j) AS j, count(*) AS k FROM met GROUP BY no, i - j, run),
    best AS (SELECT no, arg_max(struct_pack(i := i, j := j, k := k), k * 1000000000000 - i * 1000000 - j) AS b FROM runs GROUP BY no)
    SELECT id, l, r, CAST(b.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, CAST(b.k AS INTEGER) AS k FROM best JOIN cut USING (no))),
ratios AS MATERIALIZED (SELECT l, r, {six("2.0 * s / (length(l) + length(r))")} AS ratio FROM (SELECT id, sum(size) AS s FROM seg GROUP BY id) JOIN wanted USING (id))
"""


def _strength(m: Mapping) -> tuple[str, str]:
    a, b, r = f"a_{m.mapping_id}", f"b_{m.mapping_id}", f"r_{m.mapping_id}"
    if m.kind == "geography":
        return f"CASE WHEN {r} >= 0.88 THEN 0.5 * {r} ELSE 0 END", "1.0"
    if m.kind in ("name_or_title", "contact_person"):
        p = f"(0.45 * {r} + 0.4 * {_jaccard(a, b)} + 0.15 * {_overlap(a, b)})"
        return p, f"greatest(0.0, 0.55 - {p})"
    if m.kind == "address":
        x, y = number_of(a), number_of(b)
        p = f"(0.35 * CAST(({x} <> '' AND {x} = {y}) AS DOUBLE) + 0.25 * {_jaccard(a, b)} + 0.15 * {_overlap(a, b)} + 0.25 * {r})"
        return p, f"greatest(CAST(({x} <> '' AND {y} <> '' AND {x} <> {y}) AS DOUBLE), 0.35 * (1 - {p}))"
    return "0.0", "1.0"


def _bounded(x: str) -> str:
    return six(f"least(1.0, greatest(0.0, CAST({x} AS DOUBLE)))")


def scoring(mappings: Sequence[Mapping] = MAPPINGS) -> str:
    with_ratio = [m for m in mappings if m.kind in ("geography", "name_or_title", "contact_person", "address")]
    values = ", ".join(f"a.n_{m.mapping_id} AS a_{m.mapping_id}, b.n_{m.mapping_id} AS b_{m.mapping_id}, a.v_{m.mapping_id} AS av_{m.mapping_id}, b.v_{m.mapping_id} AS bv_{m.mapping_id}" for m in mappings)
    ratio_in = " UNION ALL ".join(f"SELECT a_{m.mapping_id} AS x, b_{m.mapping_id} AS y FROM valued" for m in with_ratio)
    joins = " ".join(f"LEFT JOIN ratios q_{m.mapping_id} ON q_{m.mapping_id}.l = a_{m.mapping_id} AND q_{m.mapping_id}.r = b_{m.mapping_id}" for m in with_ratio)
    ratios = ", ".join(f"coalesce(q_{m.mapping_id}.ratio, CASE WHEN a_{m.mapping_id} = b_{m.mapping_id} AND a_{m.mapping_id} <> '' THEN 1.0 ELSE 0.0 END) AS r_{m.mapping_id}" for m in with_ratio)
    strengths, weighted = [], []
    for m in mappings:
        i = m.mapping_id
        a, b = f"a_{i}", f"b_{i}"
        p, c = _strength(m)
        strengths.append(f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {_bounded(p)} END AS p_{i}")
        strengths.append(f"CASE WHEN {a} = '' OR {b} = '' OR {a} = {b} THEN 0.0 ELSE {_bounded(c)} END AS c_{i}")
        weighted.append(
            f"CASE WHEN {a} = '' AND {b} = '' THEN 'missing_both' WHEN {a} = '' THEN 'missing_left' WHEN {b} = '' THEN 'missing_right' WHEN {a} = {b} THEN 'exact_agreement' "
            f"WHEN p_{i} >= 0.35 AND p_{i} >= c_{i} THEN 'partial_agreement' ELSE 'conflict' END AS class_{i}"
        )
        weighted.append(f"{six(f'p_{i} * CAST({WEIGHTS[m.kind]} AS DOUBLE)')} AS plus_{i}, {six(f'c_{i} * CAST({WEIGHTS[m.kind] * CONFLICTS[m.kind]!r} AS DOUBLE)')} AS minus_{i}")
    total = lambda n: "(" + " + ".join(["CAST(0 AS DOUBLE)", *(f"{n}_{m.mapping_id}" for m in mappings)]) + ")"
    agree = " + ".join(f"CAST((class_{m.mapping_id} IN ('exact_agreement', 'partial_agreement') AND plus_{m.mapping_id} > 0) AS INTEGER)" for m in mappings)
    against = " OR ".join(f"(class_{m.mapping_id} = 'conflict' AND minus_{m.mapping_id} > 0)" for m in mappings if m.kind in ("persistent_identifier", "email", "domain"))
    return f"""
valued AS MATERIALIZED (SELECT pairs.*, {values} FROM pairs JOIN a ON a.row_id = a_row_id JOIN b ON b.row_id = b_row_id),
ratio_in AS ({ratio_in}),
{RATIOS},
rated AS (SELECT valued.*, {ratios} FROM valued {joins}),
strong AS (SELECT *, {", ".join(strengths)} FROM rated),
compared AS MATERIALIZED (SELECT *, {", ".join(weighted)} FROM strong),
scored AS MATERIALIZED (SELECT *, {_bounded(f"({total('plus')} - {total('minus')}) / CAST({sum(WEIGHTS[m.kind] for m in mappings)!r} AS DOUBLE)")} AS score, {agree} AS agreements, {against} AS contradiction FROM compared)
"""


RANKING = f"""
r1 AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM scored WINDOW w AS (PARTITION BY a_row_id ORDER BY score DESC, b_row_id)),
r2 AS (SELECT *, CASE WHEN rank = 1 THEN {_bounded("score - coalesce(nxt, 0.0)")} ELSE 0.0 END AS margin, sum(CASE WHEN rank = 1 AND score >= 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY b_row_id) AS wanted FROM r1),
r3 AS (SELECT *, rank = 1 AND wanted > 1 AND score >= 0.25 AS collision FROM r2),
ranked AS MATERIALIZED (SELECT *, CASE WHEN rank = 1 AND score >= 0.5 AND margin >= 0.04 AND NOT collision AND agreements >= 2 AND NOT contradiction THEN 'auto_match' ELSE 'needs_review' END AS band,
  max(score) OVER (PARTITION BY a_row_id) AS top FROM r3),
kept AS MATERIALIZED (SELECT * FROM ranked WHERE top >= 0.25 AND score >= greatest(0.25, {six("top - 0.3")}) AND rank <= 3),
auto AS MATERIALIZED (
  SELECT k.* FROM kept k JOIN (SELECT b_row_id, count(DISTINCT a_row_id) AS owners FROM kept GROUP BY b_row_id) o ON o.b_row_id = k.b_row_id
  WHERE k.rank = 1 AND k.band = 'auto_match' AND NOT k.collision AND owners = 1)
"""


def tall(mappings: Sequence[Mapping] = MAPPINGS) -> str:
    """CTE fields: kept pairs' evidence by field, with frequencies and information classes."""
    rows = " UNION ALL ".join(
        f"SELECT candidate_id, a_row_id, b_row_id, {n} AS place, '{m.mapping_id}' AS mapping_id, '{m.kind}' AS kind, av_{m.mapping_id} AS a_value, bv_{m.mapping_id} AS b_value, a_{m.mapping_id} AS a_norm, b_{m.mapping_id} AS b_norm, class_{m.mapping_id} AS class, p_{m.mapping_id} AS positive, plus_{m.mapping_id} AS plus, minus_{m.mapping_id} AS minus, {six(f"plus_{m.mapping_id} - minus_{m.mapping_id}")} AS contribution FROM kept"
        for n, m in enumerate(mappings)
    )
    counts = lambda s: " UNION ALL ".join(f"SELECT '{m.mapping_id}' AS mapping_id, n_{m.mapping_id} AS value FROM {s} WHERE n_{m.mapping_id} <> ''" for m in mappings)
    freq = lambda s: f"SELECT *, sum(n) OVER (PARTITION BY mapping_id) AS total FROM (SELECT mapping_id, value, count(*) AS n FROM ({counts(s)}) GROUP BY ALL)"
    return f"""
fa AS ({freq("a")}), fb AS ({freq("b")}), tall AS MATERIALIZED ({rows}),
fields AS MATERIALIZED (
  SELECT t.*, fa.n AS freq_a, fb.n AS freq_b, CASE WHEN class LIKE 'missing%' THEN 'not_applicable' WHEN greatest(fa.n, fb.n) IS NULL THEN 'unknown' WHEN greatest(fa.n, fb.n) <= 1 THEN 'distinctive'
    WHEN greatest(fa.n / fa.total, fb.n / fb.total) >= 0.05 THEN 'common' ELSE 'repeated' END AS information
  FROM tall t LEFT JOIN fa ON fa.mapping_id = t.mapping_id AND fa.value = a_norm LEFT JOIN fb ON fb.mapping_id = t.mapping_id AND fb.value = b_norm)
"""


REVIEW = """
owned AS MATERIALIZED (SELECT b_row_id, count(DISTINCT a_row_id) AS owners FROM kept GROUP BY b_row_id),
dec AS MATERIALIZED (
  SELECT candidate_id, a_row_id, k.b_row_id, CASE WHEN substr(candidate_id, 11, 1) IN ('0', '1', '2', '3') THEN 'same_entity' ELSE 'different_entity' END AS decision
  FROM kept k JOIN owned o ON o.b_row_id = k.b_row_id WHERE rank = 1 AND band <> 'auto_match' AND owners = 1 AND substr(candidate_id, 11, 1) IN ('0', '1', '2', '3', '4', '5')),
def AS (SELECT a_row_id, true AS deferred FROM kept WHERE rank = 1 AND band <> 'auto_match' AND substr(candidate_id, 11, 1) = '6'),
human AS (SELECT candidate_id, a_row_id, b_row_id, 'human' AS source FROM dec WHERE decision = 'same_entity'),
links AS MATERIALIZED (
  SELECT * FROM human UNION ALL SELECT candidate_id, a_row_id, b_row_id, 'system_matcher' FROM auto
  WHERE candidate_id NOT IN (SELECT candidate_id FROM dec WHERE decision = 'different_entity') AND a_row_id NOT IN (SELECT a_row_id FROM human) AND b_row_id NOT IN (SELECT b_row_id FROM human)),
picked AS (
  SELECT k.*, d.decision, row_number() OVER (PARTITION BY k.a_row_id ORDER BY CASE WHEN d.decision = 'same_entity' THEN 0 WHEN d.decision IS NULL THEN 1 ELSE 2 END, rank) AS pick,
    count(*) OVER (PARTITION BY k.a_row_id) AS candidates, max(CASE WHEN rank = 1 THEN margin END) OVER (PARTITION BY k.a_row_id) AS top_margin,
    coalesce(bool_or(d.decision = 'same_entity') OVER (PARTITION BY k.a_row_id), false) AS same, count(d.decision) OVER (PARTITION BY k.a_row_id) AS decided,
    count(*) FILTER (d.decision = 'different_entity') OVER (PARTITION BY k.a_row_id) AS rejected
  FROM kept k LEFT JOIN dec d ON d.candidate_id = k.candidate_id),
items AS MATERIALIZED (
  SELECT p.a_row_id, CASE WHEN same THEN 'reviewed_same' WHEN decided > 0 AND rejected = decided THEN 'reviewed_different' WHEN def.deferred THEN 'deferred' ELSE 'needs_review' END AS state,
    candidates, top_margin, candidate_id, p.b_row_id, rank, score, margin, collision OR owners > 1 AS collision, contradiction
  FROM picked p JOIN owned o ON o.b_row_id = p.b_row_id LEFT JOIN def ON def.a_row_id = p.a_row_id
  WHERE pick = 1 AND NOT (p.a_row_id IN (SELECT a_row_id FROM auto) AND decided = 0 AND def.deferred IS NULL))
"""


def survivorship(mappings: Sequence[Mapping] = MAPPINGS) -> str:
    """CTE vals: raw merge values of every link by field; conf: those that differ."""
    rows = " UNION ALL ".join(f"SELECT candidate_id, a_row_id, b_row_id, source, '{m.mapping_id}' AS mapping_id, coalesce(x.{m.a_column}, '') AS a_value, coalesce(y.{m.b_column}, '') AS b_value, x.updated_at AS a_time, y.updated_at AS b_time FROM links JOIN a_src x ON x.row_id = a_row_id JOIN b_src y ON y.row_id = b_row_id" for m in mappings if m.merge)
    ms = lambda c: f"CASE WHEN {c} LIKE '2024%' THEN epoch_ms(CAST(replace(replace({c}, 'T', ' '), 'Z', '') AS TIMESTAMP)) END"
    return f"""
vals AS MATERIALIZED ({rows}),
conf AS MATERIALIZED (SELECT *, 'conflict-' || candidate_id || '-' || mapping_id AS conflict_id, {ms("a_time")} AS x, {ms("b_time")} AS y FROM vals WHERE a_value <> b_value),
ruled AS MATERIALIZED (
  SELECT *, CASE mapping_id
    WHEN 'name' THEN 'A' WHEN 'phone' THEN CASE WHEN a_value = '' THEN 'B' WHEN b_value = '' THEN 'A' END WHEN 'email' THEN CASE WHEN a_value = '' THEN 'B' WHEN b_value = '' THEN 'A' END
    WHEN 'address' THEN CASE WHEN x IS NULL OR y IS NULL OR x = y THEN NULL WHEN x > y THEN 'A' ELSE 'B' END WHEN 'contact' THEN 'both' END AS chosen,
    CASE mapping_id WHEN 'name' THEN 'trusted_a' WHEN 'phone' THEN CASE WHEN a_value = '' THEN 'non_null_b' WHEN b_value = '' THEN 'non_null_a' ELSE 'both_present' END
      WHEN 'email' THEN CASE WHEN a_value = '' THEN 'non_null_b' WHEN b_value = '' THEN 'non_null_a' ELSE 'both_present' END
      WHEN 'address' THEN CASE WHEN x IS NULL OR y IS NULL THEN 'timestamp_unusable' WHEN x = y THEN 'timestamps_equal' WHEN x > y THEN 'newer_a' ELSE 'newer_b' END WHEN 'contact' THEN 'kept_both' ELSE 'no_rule' END AS reason
  FROM conf)
"""


TRUTH = "truth AS MATERIALIZED (SELECT x.row_id AS a_row_id, y.row_id AS b_row_id FROM a_src x JOIN b_src y USING (entity_id))"


def chain(upto: str) -> str:
    """WITH clause up to a stage: sources, pairs, scored, kept or fields."""
    parts = {"sources": prepared(), "pairs": BLOCKING, "scored": scoring(), "kept": RANKING, "fields": tall(), "review": REVIEW, "survive": survivorship(), "truth": TRUTH}
    names = list(parts)
    return "WITH RECURSIVE " + ", ".join(parts[n] for n in names[: names.index(upto) + 1])
