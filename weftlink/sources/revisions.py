"""Revisions of a run's tables: written aside, then committed by one file that only one writer can create.

Below a root that driver and executors share: `<run>/sources/<side>` (written once), `<run>/data/<uuid>/<table>` and
`<run>/revisions/<n>.json`, which names the tables of revision n. A revision exists once its file does, so a writer that dies
between its data and its commit leaves what was there; its data is found by `orphans`.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from weftlink.plans.model import Invalid

from .tables import exists

SNAPSHOT = "run-state-snapshot-v1"


class RevisionConflict(Invalid):
    """Another writer has committed the next revision."""


class Repository:
    """Runs and their revisions below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    @staticmethod
    def _run(run_id: str) -> str:
        if not re.fullmatch(r"run-[0-9a-fA-F-]+", run_id):
            raise Invalid(f"run id {run_id!r} is invalid")
        return run_id

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _create(self, text: str, *parts: str) -> bool:
        """Makes a whole file appear at once, unless there is one."""
        final, draft = self._path(*parts), self._path(*parts[:-1], f".{uuid.uuid4().hex}.draft")
        fs = final.getFileSystem(self._conf)
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a rename of local files replaces, a hard link doesn't
                place = lambda p: unquote(urlparse(p.toUri().toString()).path)
                try:
                    os.link(place(draft), place(final))
                except FileExistsError:
                    return False
                return True
            # a rename without overwriting is atomic in a distributed file system
            return not fs.exists(final) and fs.rename(draft, final)
        finally:
            fs.delete(draft, False)

    def _read(self, *parts: str) -> str:
        path = self._path(*parts)
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def runs(self) -> list[str]:
        return [n for n in self._names() if self.revisions(n)]

    def revisions(self, run_id: str) -> list[int]:
        found = (re.fullmatch(r"(\d+)\.json", n) for n in self._names(self._run(run_id), "revisions"))
        return sorted(int(m[1]) for m in found if m)

    def save_source(self, run_id: str, side: str, rows: DataFrame) -> None:
        """A side's rows, written once; they never change."""
        if side not in ("A", "B"):
            raise Invalid("a source is A or B")
        parts = (self._run(run_id), "sources", side)
        data = f"{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{run_id}/data/{data}/{side}")
        if not self._create(json.dumps({"path": f"{run_id}/data/{data}/{side}", "schema": rows.schema.json()}), *parts[:-1], f"{side}.json"):
            raise Invalid(f"source {side} of {run_id} is there already")

    def source(self, run_id: str, side: str) -> DataFrame:
        return self._table(json.loads(self._read(self._run(run_id), "sources", f"{side}.json")))

    def _table(self, entry: Mapping[str, str]) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/{entry['path']}")

    def _entry(self, run_id: str, revision: int) -> dict:
        found = json.loads(self._read(run_id, "revisions", f"{revision}.json"))
        if found.get("snapshotVersion") != SNAPSHOT or found.get("runId") != run_id or found.get("revision") != revision or "state" not in found:
            raise Invalid("persisted run state uses an unsupported schema")
        return found

    def load(self, run_id: str, revision: int | None = None) -> tuple[int, object, dict[str, DataFrame]]:
        """(revision, state, tables) of a revision, the last one unless asked; revision 0 is an empty run."""
        known = self.revisions(run_id)
        if revision is not None and revision not in known:
            raise Invalid(f"{run_id} has no revision {revision}")
        if not known:
            return 0, None, {}
        found = self._entry(run_id, revision or known[-1])
        return found["revision"], found["state"], {n: self._table(t) for n, t in found["tables"].items()}

    def save(self, run_id: str, expected: int, state: object, tables: Mapping[str, DataFrame] | None = None) -> int:
        """Commits revision expected + 1; tables that aren't given stay as they are. Refused if another writer was first."""
        known = self.revisions(run_id)
        last = known[-1] if known else 0
        if last != expected:
            raise RevisionConflict(f"{run_id} is at revision {last}, not {expected}")
        kept = self._entry(run_id, last)["tables"] if last else {}
        folder = f"{run_id}/data/{uuid.uuid4().hex}"
        for name, rows in (tables or {}).items():
            rows.write.parquet(f"{self.root}/{folder}/{name}")
            kept[name] = {"path": f"{folder}/{name}", "schema": rows.schema.json()}
        entry = {"snapshotVersion": SNAPSHOT, "runId": run_id, "savedAt": datetime.now(UTC).isoformat(), "revision": expected + 1, "state": state, "tables": kept}
        if not self._create(json.dumps(entry), run_id, "revisions", f"{expected + 1}.json"):
            raise RevisionConflict(f"another writer has committed revision {expected + 1} of {run_id}")
        return expected + 1

    def orphans(self, run_id: str) -> list[str]:
        """Folders of data that no revision or source names: of writers at work, dead or refused."""
        used = {t["path"].split("/")[2] for r in self.revisions(run_id) for t in self._entry(run_id, r)["tables"].values()}
        used |= {json.loads(self._read(run_id, "sources", f"{s}.json"))["path"].split("/")[2] for s in ("A", "B") if exists(self.spark, f"{self.root}/{run_id}/sources/{s}.json")}
        return [n for n in self._names(run_id, "data") if n not in used]
