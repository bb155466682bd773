"""One match from end to end, as one lineage: prepare, block, join, compare, score, rank, keep."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame

from weftlink.operators import blocking, compare, decide
from weftlink.sources.tables import delete, exists, materialized, shared_folder

from .model import CandidateConfig, Mapping, Rules, check_mappings, identity


@dataclass
class Match:
    """Lazy stages of a match of A and B; each is a DataFrame."""

    a: DataFrame
    b: DataFrame
    mappings: Sequence[Mapping]
    config: CandidateConfig = CandidateConfig()
    rules: Rules = Rules()
    id_column: str = "row_id"
    policy: str = "assignment-one-to-one-conservative-v1"
    folders: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        check_mappings(self.mappings, self.a.columns, self.b.columns)

    def _shared(self, df: DataFrame) -> DataFrame:
        """Stages that many views read are written once, so that each view's plan starts at a table."""
        self.folders.append(shared_folder(df.sparkSession))
        return materialized(df, self.folders[-1])

    def readable(self) -> bool:
        """Whether all that was written is still there."""
        return all(exists(self.a.sparkSession, f) for f in self.folders)

    def remove(self) -> None:
        for f in self.folders:
            delete(self.a.sparkSession, f)

    def with_config(self, config: CandidateConfig) -> Match:
        """The same sources, already prepared, under another candidate configuration."""
        other = replace(self, config=config, folders=[])
        other.__dict__["rows"] = self.rows
        return other

    @cached_property
    def identity(self) -> list[Mapping]:
        return identity(self.mappings)

    @cached_property
    def rows(self) -> tuple[DataFrame, DataFrame]:
        return tuple(self._shared(blocking.prepared(df, side, self.mappings, self.id_column)) for df, side in ((self.a, "A"), (self.b, "B")))

    @cached_property
    def keys(self) -> tuple[DataFrame, DataFrame]:
        return tuple(self._shared(blocking.keys(rows, self.mappings, self.config)) for rows in self.rows)

    @cached_property
    def buckets(self) -> DataFrame:
        return blocking.buckets(*self.keys, self.config)

    @cached_property
    def pairs(self) -> DataFrame:
        return self._shared(blocking.pairs(blocking.relationships(*self.keys, self.buckets)))

    @cached_property
    def compared(self) -> DataFrame:
        """Evidence of all pairs, wide; made anew by each view, of the fields that it reads."""
        return compare.evidence(compare.joined(blocking.dealt(self.pairs.drop("blocking_evidence")), *self.rows), self.identity)

    @cached_property
    def scored(self) -> DataFrame:
        """Scores alone: nothing wide is written, ranked or shuffled for all pairs."""
        return self._shared(compare.scored(self.compared, self.identity).select("candidate_id", "a_row_id", "b_row_id", "score", "agreements", "contradiction"))

    @cached_property
    def ranked(self) -> DataFrame:
        return self._shared(decide.ranked(self.scored, self.rules))

    @cached_property
    def kept(self) -> DataFrame:
        return self._shared(decide.retained(self.ranked, self.rules))

    @cached_property
    def automatic(self) -> DataFrame:
        return decide.automatic(self.kept, self.policy)

    @cached_property
    def fields(self) -> DataFrame:
        """Evidence of the kept pairs, one row for each field, with information classes."""
        kept = compare.evidence(compare.joined(blocking.dealt(self.kept.select("candidate_id", "a_row_id", "b_row_id")), *self.rows), self.identity)
        return self._shared(compare.information(compare.tall(kept, self.identity), *(compare.frequencies(r, self.identity) for r in self.rows)))
