"""The review journal: an append-only log of commands, folded in order to what each came to and to the state it leaves.

A log has run_id, seq, action, targets, a_row_id, decision, conflict_id. Actions: `decide` (targets: one candidate, or those
of a batch, all or none), `defer` and `restore` (a_row_id), `resolve`, `replace` and `clear` (conflict_id), `undo`. A command
that isn't allowed gets a code and changes nothing, so a log may be folded again from its start at any time.

What a command needs to know of the match (its candidates' rows, whether they are automatic, whether values differ) is
joined to it first. The fold then reads each run's commands in order, as sorted rows that pass by, and holds the run's
current state only: runs are dealt over tasks, one run's commands can't be, as each may depend on all before it.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Commands that can be undone, counted back from the last.
UNDO_DEPTH = 20
COMMANDS = "run_id string, seq long, action string, targets array<string>, a_row_id string, decision string, conflict_id string"
_FOLDED = "run_id string, kind string, seq long, key string, value string"


class Run:
    """The current state of one run's review."""

    def __init__(self):
        self.decisions: dict[str, tuple] = {}  # candidate -> (decision, seq, a row, b row)
        self.same_a: dict[str, str] = {}
        self.same_b: dict[str, str] = {}
        self.decided = Counter()  # by A row
        self.deferred: set[str] = set()
        self.resolved: dict[str, str] = {}  # conflict -> candidate
        self.resolutions = Counter()  # by candidate
        self.stack: deque = deque(maxlen=UNDO_DEPTH)

    def _add(self, t: dict, decision: str, seq: int) -> None:
        self.decisions[t["id"]] = (decision, seq, t["a"], t["b"])
        self.decided[t["a"]] += 1
        if decision == "same_entity":
            self.same_a[t["a"]], self.same_b[t["b"]] = t["id"], t["id"]

    def _remove(self, candidate: str) -> None:
        decision, _, a, b = self.decisions.pop(candidate)
        self.decided[a] -= 1
        if decision == "same_entity":
            del self.same_a[a], self.same_b[b]

    def _refusal(self, t: dict, decision: str) -> str | None:
        if t["a"] is None:
            return "candidate_not_found"
        if t["id"] in self.decisions:
            return "decision_exists"
        if decision == "different_entity":
            return "identity_change_blocked_by_resolutions" if self.resolutions[t["id"]] else None
        if t["a"] in self.same_a:
            return "identity_already_confirmed"
        return "b_row_already_confirmed" if t["b"] in self.same_b else None

    def decide(self, c: dict) -> str:
        added = []
        for t in c["targets"]:
            if refused := self._refusal(t, c["decision"]):
                for x in reversed(added):
                    self._remove(x["id"])
                return refused
            self._add(t, c["decision"], c["seq"])
            added.append(t)
        back = [a for a in dict.fromkeys(t["a"] for t in added) if a in self.deferred]
        self.deferred.difference_update(back)
        self.stack.append(([t["id"] for t in added], c["seq"], back))
        return "accepted"

    def undo(self, c: dict) -> str:
        if not self.stack:
            return "nothing_to_undo"
        candidates, seq, back = self.stack[-1]
        if any(self.decisions.get(x, (None, None))[1] != seq for x in candidates):
            return "undo_state_changed"
        if any(self.decisions[x][0] == "same_entity" and self.resolutions[x] for x in candidates):
            return "undo_blocked_by_resolutions"
        for x in candidates:
            self._remove(x)
        self.deferred.update(back)
        self.stack.pop()
        return "accepted"

    def _linked(self, t: dict) -> bool:
        if t["id"] in self.decisions:
            if self.decisions[t["id"]][0] == "same_entity":
                return True
            return False
        return t["auto"] and t["a"] not in self.same_a and t["b"] not in self.same_b

    def resolve(self, c: dict) -> str:
        t, conflict = c["conflict"], c["conflict_id"]
        same = t is not None and self.decisions.get(t["id"], ("",))[0] == "same_entity"
        if t is None or not (same or t["auto"]):
            return "conflict_not_found"
        if c["action"] == "clear":
            if conflict not in self.resolved:
                return "resolution_missing"
            self.resolutions[self.resolved.pop(conflict)] -= 1
            return "accepted"
        if not self._linked(t):
            return "identity_not_confirmed"
        if conflict in self.resolved:
            return "accepted" if c["action"] == "replace" else "resolution_exists"
        self.resolved[conflict] = t["id"]
        self.resolutions[t["id"]] += 1
        return "accepted"

    def defer(self, c: dict) -> str:
        a, facts = c["a_row_id"], c["row"]
        if facts is None:
            return "review_item_not_found"
        quiet = facts["auto"] and not self.decided[a] and a not in self.deferred
        if a in self.same_a or self.decided[a] >= facts["candidates"] or quiet:
            return "review_item_resolved"
        (self.deferred.add if c["action"] == "defer" else self.deferred.discard)(a)
        return "accepted"

    def apply(self, c: dict) -> str:
        of = {"decide": self.decide, "undo": self.undo, "defer": self.defer, "restore": self.defer, "resolve": self.resolve, "replace": self.resolve, "clear": self.resolve}
        return of[c["action"]](c) if c["action"] in of else "unknown_action"

    def rows(self) -> Iterator[tuple]:
        """(kind, key, value) of all that holds now."""
        yield from (("decision", x, d[0]) for x, d in self.decisions.items())
        yield from (("deferral", a, "deferred") for a in self.deferred)
        yield from (("resolution", x, c) for x, c in self.resolved.items())


def _values(column: pa.Array) -> list:
    """What to_pylist gives, read child by child and in bulk: most commands have one target and no more."""
    if pa.types.is_struct(column.type):
        names = [f.name for f in column.type]
        rows = zip(*map(_values, column.drop_null().flatten()), strict=True)
        return [dict(zip(names, next(rows), strict=True)) if there else None for there in _values(column.is_valid())]
    if pa.types.is_list(column.type):
        items = iter(_values(column.flatten()))
        return [None if n is None else list(islice(items, n)) for n in pc.list_value_length(column).to_pylist()]
    if pa.types.is_string(column.type) or pa.types.is_boolean(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("run_id", pa.string()), ("kind", pa.string()), ("seq", pa.int64()), ("key", pa.string()), ("value", pa.string())])

    def rows() -> Iterator[tuple]:
        now, run = None, None
        for batch in batches:
            names = batch.schema.names
            for values in zip(*map(_values, batch.columns), strict=True):
                c = dict(zip(names, values, strict=True))
                if run is None or c["run_id"] != now:
                    if run:
                        yield from ((now, kind, None, key, value) for kind, key, value in run.rows())
                    now, run = c["run_id"], Run()
                yield now, "outcome", c["seq"], c["action"], run.apply(c)
        if run:
            yield from ((now, kind, None, key, value) for kind, key, value in run.rows())

    held = []
    for r in rows():
        held.append(r)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def with_facts(log: DataFrame, kept: DataFrame, auto: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Commands with what they need of the match. conflicts: conflict_id, candidate_id of all kept pairs whose values differ."""
    pairs = kept.select("candidate_id", "a_row_id", "b_row_id").join(auto.select("candidate_id", F.lit(True).alias("auto")), "candidate_id", "left")
    pairs = pairs.select("candidate_id", F.struct(F.col("candidate_id").alias("id"), F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"), F.coalesce("auto", F.lit(False)).alias("auto")).alias("pair"))
    rows = pairs.groupBy(F.col("pair.a").alias("a_row_id")).agg(F.struct(F.count("*").alias("candidates"), F.bool_or("pair.auto").alias("auto")).alias("row"))
    asked = log.select("run_id", "seq", F.posexplode("targets").alias("place", "candidate_id")).join(pairs, "candidate_id", "left")
    unknown = F.struct(F.col("candidate_id").alias("id"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(False).alias("auto"))
    asked = asked.groupBy("run_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("pair", unknown).alias("pair")))), lambda x: x["pair"]).alias("pairs"))
    differing = conflicts.select("conflict_id", "candidate_id").join(pairs, "candidate_id").select("conflict_id", F.col("pair").alias("conflict"))
    # most commands name no row and no conflict: only those that do are looked up, or all the others' nulls would meet in one task
    named = lambda c, facts: log.where(F.col(c).isNotNull()).select("run_id", "seq", c).join(facts, c).drop(c)
    out = log.drop("targets")
    for facts in (asked, named("a_row_id", rows), named("conflict_id", differing)):
        out = out.join(facts, ["run_id", "seq"], "left")
    return out.select("run_id", "seq", "action", F.coalesce("pairs", F.array().cast("array<struct<id:string,a:string,b:string,auto:boolean>>")).alias("targets"), "a_row_id", "row", "decision", "conflict_id", "conflict")


def folded(log: DataFrame, kept: DataFrame, auto: DataFrame, conflicts: DataFrame) -> DataFrame:
    """run_id, kind, seq, key, value: an `outcome` for each command (key its action, value accepted or a code), and the state
    that holds at the end as `decision`, `deferral` and `resolution`."""
    known = with_facts(log, kept, auto, conflicts)
    return known.repartition("run_id").sortWithinPartitions("run_id", "seq").mapInArrow(_fold, _FOLDED)


def outcomes(fold: DataFrame) -> DataFrame:
    return fold.where("kind = 'outcome'").select("run_id", "seq", F.col("key").alias("action"), F.col("value").alias("outcome"))


def state(fold: DataFrame) -> DataFrame:
    return fold.where("kind <> 'outcome'").select("run_id", "kind", "key", "value")


def decisions(fold: DataFrame, run_id: str) -> DataFrame:
    """The current decisions of a run, as the review operators read them."""
    return fold.where((F.col("run_id") == run_id) & (F.col("kind") == "decision")).select(F.col("key").alias("candidate_id"), F.col("value").alias("decision"))
