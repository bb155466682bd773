"""Exports: reconciliation and merged tables, defended cells, manifests, and their verification."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.plans.model import Invalid, canonical_hash

# A cell starts a formula if, after white space, invisible and control characters, one of these follows.
_DANGER = r"^[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF\u200B\u2060\p{Cc}]*[=+\-@\uFF1D\uFF0B\uFF0D\uFF20]|^[\t\r\n]"
_PLAIN_NUMBER = r"(?i)^-?(\d+(\.\d*)?|\.\d+)(e[-+]?\d+)?$"


def defended(c: Column) -> Column:
    """The cell, with an apostrophe before what a spreadsheet would run; plain numbers stay, also with a minus or an exponent."""
    return F.when(c.rlike(_PLAIN_NUMBER), c).when(c.rlike(_DANGER), F.concat(F.lit("'"), c)).otherwise(c)


def cell(c: Column) -> Column:
    """A defended CSV cell, quoted where it must be."""
    d = defended(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(d.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(d, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(d)


def line(columns: Sequence[str]) -> Column:
    """A row's columns as one line of CSV."""
    return F.concat_ws(",", *[cell(F.col(f"`{c}`")) for c in columns])


def csv_lines(df: DataFrame) -> DataFrame:
    """One column, line, of the rows as CSV; write it with write_csv."""
    return df.select(line(df.columns).alias("line"))


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted CSV with CRLF line ends; each part file stands for a range, so the parts in order are the whole."""
    df.orderBy(*order).transform(csv_lines).write.option("lineSep", "\r\n").text(path)


def reconciliation(a: DataFrame, b: DataFrame, links: DataFrame, items: DataFrame, kept: DataFrame) -> DataFrame:
    """Every row of either source once, in one of five classes."""
    open_items = items.where("state IN ('needs_review', 'deferred')").select("a_row_id").join(links.select("a_row_id"), "a_row_id", "left_anti")
    linked = links.select(F.when(F.col("source") == "human", "linked_human").otherwise("linked_automatic").alias("row_class"), "a_row_id", "b_row_id")
    rest_a = a.select(F.col("row_id").alias("a_row_id")).join(links.select("a_row_id"), "a_row_id", "left_anti").join(open_items, "a_row_id", "left_anti")
    under = kept.join(open_items, "a_row_id", "left_semi").select("b_row_id")
    rest_b = b.select(F.col("row_id").alias("b_row_id")).join(links.select("b_row_id"), "b_row_id", "left_anti").join(under, "b_row_id", "left_anti")
    none = F.lit("")
    return linked.union(open_items.select(F.lit("needs_review"), "a_row_id", none)).union(rest_a.select(F.lit("only_a"), "a_row_id", none)).union(rest_b.select(F.lit("only_b"), none, "b_row_id"))


def safe_token(run_id: str) -> str:
    """A part of a file name that is safe anywhere."""
    return re.sub(r"-+", "-", re.sub(r"[^A-Za-z0-9_-]", "-", run_id)).strip("-")[:64] or "run"


def safe_filename(name: str) -> str:
    """The base name of an upload; CSV only, at most 200 characters."""
    base = re.split(r"[\\/]", name)[-1].strip()
    if not base.lower().endswith(".csv") or len(base) <= 4:
        raise Invalid("only .csv files")
    return base[:-4][:196] + ".csv"


def manifest(artifacts: dict[str, bytes], state: object, versions: dict[str, str]) -> dict:
    """What was exported, with hashes and lengths of the bytes and of the state behind them."""
    files = [{"name": n, "sha256": hashlib.sha256(x).hexdigest(), "bytes": len(x)} for n, x in sorted(artifacts.items())]
    return {"schema": "run-manifest-v1.0.0", "versions": versions, "state_sha256": canonical_hash(state), "artifacts": files}


def verify(text: str | bytes, artifacts: dict[str, bytes]) -> list[str]:
    """Codes of what is wrong between a manifest and files; none means consistent."""
    try:
        found = json.loads(text)
        files = {f["name"]: f for f in found["artifacts"]}
    except (ValueError, KeyError, TypeError):
        return ["manifest_unreadable"]
    problems = [] if found.get("schema") == "run-manifest-v1.0.0" else ["schema_unsupported"]
    problems += [f"missing:{n}" for n in files if n not in artifacts] + [f"unexpected:{n}" for n in artifacts if n not in files]
    for n in files.keys() & artifacts.keys():
        if files[n].get("bytes") != len(artifacts[n]):
            problems.append(f"length:{n}")
        if files[n].get("sha256") != hashlib.sha256(artifacts[n]).hexdigest():
            problems.append(f"hash:{n}")
    return sorted(problems)


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order: equal for a replay that gives the same rows."""
    cols = sorted(df.columns)
    h = df.select(F.xxhash64(*cols).alias("x"), F.hash(*cols).alias("y")).agg(F.count("*"), F.sum(F.col("x").cast("decimal(38,0)")), F.sum(F.col("y").cast("long"))).first()
    return canonical_hash([*cols, *map(str, h)])
