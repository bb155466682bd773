"""Sources whose identifiers are made weak by draws that follow from seed, side, row and field alone, in any order of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.plans.model import Invalid


@dataclass(frozen=True)
class WeakPolicy:
    """Which share of each identifier is lost, changed in one character, gone stale or written another way."""

    seed: int
    phone_missing: float = 0.45
    phone_corrupt: float = 0.40
    email_missing: float = 0.45
    email_typo: float = 0.40
    domain_missing: float = 0.45
    domain_stale: float = 0.40
    domain_format: float = 0.10

    def __post_init__(self) -> None:
        groups = ((self.phone_missing, self.phone_corrupt), (self.email_missing, self.email_typo), (self.domain_missing, self.domain_stale, self.domain_format))
        if not 0 <= self.seed < 2**63 or any(not 0 <= r <= 1 for g in groups for r in g) or any(sum(g) > 1 for g in groups):
            raise Invalid("exclusive weak-identifier rates may not exceed 1")


def digest(seed: int, side: str, row_id: Column, field: str) -> Column:
    """The hash that all draws of a cell come from, in hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{seed}:{side}:"), row_id, F.lit(f":{field}")), 256)


def _number(hexed: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(hexed, start, digits), 16, 10)


def draw(hexed: Column) -> Column:
    """The first eight bytes as a number from 0 to 1."""
    return _number(hexed, 1, 16).cast("decimal(20,0)").cast("double") / float(2**64)


def _place(text: Column, pattern: str, hexed: Column) -> Column:
    """Which character of those that match the draw takes, from 1; null if none does."""
    places = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)).rlike(pattern))
    return F.when((F.length(text) > 0) & (F.size(places) > 0), F.get(places, (_number(hexed, 1, 4).cast("int") % F.size(places))))


def _put(text: Column, place: Column, character: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), place - 1), character, F.substr(text, place + 1))


def corrupt_phone(value: Column, hexed: Column) -> Column:
    """Another digit in place of one; the value itself without digits."""
    at = _place(value, "[0-9]", hexed)
    digit = (F.substr(value, at, F.lit(1)).cast("int") + 1 + _number(hexed, 5, 2).cast("int") % 8) % 10
    return F.coalesce(_put(value, at, digit.cast("string")), value)


def corrupt_email(value: Column, hexed: Column) -> Column:
    """Another letter in place of one of the domain's; the value itself if it isn't of one @ with a letter after it."""
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    at = _place(host, "[A-Za-z]", hexed)
    letter = F.char((F.ascii(F.lower(F.substr(host, at, F.lit(1)))) - 97 + 1 + _number(hexed, 5, 2).cast("int") % 24) % 26 + 97)
    one = F.length(value) - F.length(F.replace(value, F.lit("@"), F.lit(""))) == 1
    return F.when(one & at.isNotNull(), F.concat(local, F.lit("@"), _put(host, at, letter))).otherwise(value)


def format_domain(value: Column, side: str) -> Column:
    """The same host, written as a directory's address on side A, with www on side B."""
    candidate = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("//"), value))
    host = F.regexp_replace(F.lower(F.regexp_extract(candidate, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    written = F.concat(F.lit("https://www."), host, F.lit("/directory")) if side == "A" else F.concat(F.lit("www."), host)
    return F.when(host == "", value).otherwise(written)


def stale_domain(side: str, hexed: Column) -> Column:
    return F.concat(F.lit("https://legacy-" if side == "A" else "legacy-"), F.substring(hexed, 1, 12), F.lit(".invalid"))


def weakened(df: DataFrame, side: str, policy: WeakPolicy, id_column: str, phone: str = "phone", email: str = "email", website: str = "website") -> DataFrame:
    """The rows with weak identifiers, and events: what happened to each, as field, strategy, before and after.

    Built-in expressions over each row by itself: no shuffle, and the same rows whatever their partitions.
    """
    if side not in ("A", "B"):
        raise Invalid("a side is A or B")
    row_id = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    ways = {
        (phone, "phone"): [(policy.phone_missing, "weak_policy_missing", lambda v, h: F.lit("")), (policy.phone_corrupt, "weak_policy_digit_corruption", corrupt_phone)],
        (email, "email"): [(policy.email_missing, "weak_policy_missing", lambda v, h: F.lit("")), (policy.email_typo, "weak_policy_typo", corrupt_email)],
        (website, "website_domain"): [
            (policy.domain_missing, "weak_policy_missing", lambda v, h: F.lit("")), (policy.domain_stale, "weak_policy_stale", lambda v, h: stale_domain(side, h)), (policy.domain_format, "weak_policy_format", lambda v, h: format_domain(v, side)),
        ],
    }
    out, events, drawn = {}, [], {}
    for (column, field), _ in ways.items():
        drawn[f"_h_{field}"] = digest(policy.seed, side, row_id, field)
    for (column, field), choices in ways.items():
        before, hexed = F.coalesce(F.col(column).cast("string"), F.lit("")), F.col(f"_h_{field}")
        after, strategy, below = before, F.lit(None).cast("string"), 0.0
        cases = []
        for rate, name, change in choices:
            below += rate
            cases.append((draw(hexed) < below, name, change(before, hexed)))
        for test, name, value in reversed(cases):
            after, strategy = F.when(test, value).otherwise(after), F.when(test, name).otherwise(strategy)
        after = F.when(before == "", before).otherwise(after)
        out[column] = after
        events.append(F.when(after != before, F.struct(F.lit(field).alias("field"), strategy.alias("strategy"), before.alias("before"), after.alias("after"))))
    return df.withColumns(drawn).withColumns(out | {"events": F.array_compact(F.array(*events))}).drop(*drawn)
