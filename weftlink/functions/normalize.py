"""Normalizers and tokenisers as column expressions; they stay in the JVM for ASCII text.

Compatibility forms and case folding of other scripts have no built-in. A column that holds other text goes through
`folded`, one vectorised function, first; the normalizers then take it as it is with `unicode=True`.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Company endings that names lose, and street words that addresses shorten.
SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated", "llc", "ltd", "limited")
STREET_WORDS = {"avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "street": "st"}


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """Compatibility form, stripped and case-folded."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip().casefold())


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _low(c: Column, unicode: bool) -> Column:
    return F.coalesce(c if unicode else F.lower(c), F.lit(""))


def text(c: Column, unicode: bool = False) -> Column:
    """Lower case, every run of characters other than letters, digits and underscores as one space."""
    low = _low(c, unicode)
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\P{Nd}", "")


def phone(c: Column) -> Column:
    """Digits; a leading 1 of eleven goes; fewer than seven are nothing."""
    d = digits(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) < 7, F.lit("")).otherwise(d)


def domain(c: Column, unicode: bool = False) -> Column:
    """The host of a URL or host name without www; nothing if it has no dot or a space."""
    low = F.trim(_low(c, unicode))
    with_scheme = F.when(low.contains("://"), low).otherwise(F.concat(F.lit("//"), low))
    host = F.regexp_extract(with_scheme, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(host.contains(".") & ~host.contains(" "), host).otherwise(F.lit(""))


def email(c: Column, unicode: bool = False) -> Column:
    """Lower case without white space; nothing unless it has one @, a local part and a domain."""
    e = F.regexp_replace(_low(c, unicode), r"[\s\x1C-\x1F\u0085\p{Z}]+", "")
    parts = F.split(e, "@")
    return F.when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (domain(F.get(parts, F.lit(1)), unicode) != ""), e).otherwise(F.lit(""))


def email_domain(c: Column) -> Column:
    return F.when(c != "", F.substring_index(c, "@", -1)).otherwise(F.lit(""))


def name(c: Column, unicode: bool = False) -> Column:
    """Text without company endings at its tail."""
    return F.trim(F.regexp_replace(text(c, unicode), f"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", ""))


def postal(c: Column, unicode: bool = False) -> Column:
    """Letters and digits of the text; its first five if they are digits."""
    p = F.regexp_replace(text(c, unicode), "[^a-z0-9]", "")
    return F.when(p.rlike("^[0-9]{5}"), F.substring(p, 1, 5)).otherwise(p)


def address(c: Column, unicode: bool = False) -> Column:
    out = text(c, unicode)
    for long, short in STREET_WORDS.items():
        out = F.regexp_replace(out, rf"(?<![^ ]){long}(?![^ ])", short)
    return out


def address_number(normal: Column) -> Column:
    """The first token of a normalized address if it is all digits."""
    return F.regexp_extract(normal, r"^(\p{Nd}+)(?: |$)", 1)


def tokens(normal: Column) -> Column:
    return F.array_remove(F.split(normal, " "), "")


def meaningful(normal_name: Column, stop: tuple[str, ...]) -> Column:
    """Distinct tokens of at least three characters that aren't stop tokens."""
    return F.array_distinct(F.filter(F.split(normal_name, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*stop)))


def compact(normal_name: Column) -> Column:
    return F.regexp_replace(normal_name, r"[^\p{L}\p{N}]", "")


def number(c: Column) -> Column:
    """A plain decimal without thousands separators, exponent or trailing zeros; the trimmed text if it is none."""
    bare = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")
    return F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_replace(plain, r"\.$", "")).otherwise(text(c))


def date(c: Column) -> Column:
    """An ISO day; the normalized text if it is none."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(bare, "yyyy-MM-dd").isNotNull(), bare).otherwise(text(c))


def legacy(c: Column, normalizer: str) -> Column:
    """The older normalizers; phones have no least length here."""
    return {"text": text, "phone": digits, "email": lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", ""), "number": number, "date": date}[normalizer](c)


def of_kind(kind: str, c: Column, unicode: bool = False) -> Column:
    """The normalizer of a field's kind. Places aren't cut to postal codes unless the kind is postal."""
    if kind in ("name", "name_or_title", "contact_person"):
        return name(c, unicode)
    if kind == "address":
        return address(c, unicode)
    if kind == "phone":
        return phone(c)
    return {"email": email, "domain": domain, "postal": postal}.get(kind, text)(c, unicode)


def missing(c: Column) -> Column:
    """Blank after trimming; words such as NULL are values."""
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*$")


def instant(c: Column) -> Column:
    """Milliseconds of a day, or of a time with an offset; null for anything else."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    day = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(bare, F.lit("T00:00:00Z"))))
    timed = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(bare))
    return F.unix_millis(F.coalesce(day, timed))


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def candidate_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.substring(F.sha2(F.concat(a, F.char(F.lit(0)), b), 256), 1, 20))
