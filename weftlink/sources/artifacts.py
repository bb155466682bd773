"""Evaluation artifacts: a report, its summary in Markdown, the snapshots' catalog, and the errors of each snapshot."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

from weftlink.plans.model import Invalid

from .tables import _folder


def _write(spark, path: str, text: str) -> None:
    target, fs = _folder(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _json(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def markdown(snapshots: Mapping[str, list[dict]], comparison: list[dict]) -> str:
    """A table of each snapshot's metrics, and of the comparison, with dashes where there is no value."""
    show = lambda v: "–" if v is None else f"{v:.4f}"
    lines = ["# Evaluation", ""]
    for name, rows in snapshots.items():
        lines += [f"## {name}", "", "| Metric | Value | Of |", "| --- | --- | --- |", *[f"| {r['metric']} | {show(r['value'])} | {r['numerator']} / {r['denominator']} |" for r in rows], ""]
    if comparison:
        lines += ["## Comparison", ""]
        if comparison[0]["reasons"]:
            lines += [f"Not directly comparable. {comparison[0]['reasons']}", ""]
        lines += ["| Metric | A | B | Difference |", "| --- | --- | --- | --- |", *[f"| {r['metric']} | {show(r['version_a'])} | {show(r['version_b'])} | {show(r['delta'])} |" for r in comparison], ""]
    return "\n".join(lines)


def write_artifacts(folder: str, snapshots: Mapping[str, DataFrame], comparison: DataFrame, errors: Mapping[str, DataFrame]) -> list[str]:
    """Writes report.json, summary.md, catalog.json, and the errors of each snapshot as a table; gives the files' names.

    Snapshots and comparisons have a fixed number of rows and pass through the driver; errors don't.
    """
    if set(errors) - set(snapshots):
        raise Invalid("errors of a snapshot that isn't there")
    spark = comparison.sparkSession
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["metric"])  # noqa: E731  nine rows
    found, compared = {n: rows(df) for n, df in snapshots.items()}, rows(comparison)
    tables = {}
    for name, df in errors.items():
        tables[name] = f"errors/{name}"
        df.write.partitionBy("group").parquet(f"{folder}/{tables[name]}")
    catalog = [{"id": n, "metrics": len(r), "errors": tables.get(n)} for n, r in sorted(found.items())]
    files = {"report.json": _json({"snapshots": found, "comparison": compared}), "summary.md": markdown(found, compared), "catalog.json": _json(catalog)}
    for name, text in files.items():
        _write(spark, f"{folder}/{name}", text)
    return sorted([*files, *tables.values()])
