"""The older matcher as a baseline, snapshots of quality as nine ratios, and their comparison."""

from __future__ import annotations

from collections.abc import Mapping as Dict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.functions import similarity as S
from weftlink.plans.model import Invalid, Mapping, Rules, canonical_hash, identity

from .blocking import dealt
from .compare import joined, legacy_strength
from .evaluate import _PAIR, _ratio

# The older matcher's rules.
BASELINE_RULES = Rules(auto=0.82, review=0.38, margin=0.08, agreements=1, floor=0.30, window=0.25, alternatives=3, gate_contradictions=False, gate_agreements=False)


def baseline_rows(rows: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Prepared rows with the older normalizers' values in place of n_<id>."""
    return rows.select("row_id", *[N.legacy(F.col(f"v_{m.mapping_id}"), m.normalizer).alias(f"n_{m.mapping_id}") for m in identity(mappings)])


def baseline_scored(found: DataFrame, a: DataFrame, b: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Pairs scored by the mean contribution over the identity mappings: 1 if equal, the ratio of texts that are alike, else 0."""
    used = identity(mappings)
    pairs = joined(dealt(found.select("candidate_id", *_PAIR)), baseline_rows(a, used), baseline_rows(b, used))
    value = lambda m: (F.col(f"a_n_{m.mapping_id}"), F.col(f"b_n_{m.mapping_id}"))
    pairs = pairs.withColumns({f"ratio_{m.mapping_id}": S.character_ratio(*value(m)) if m.normalizer == "text" else F.lit(0.0) for m in used})
    total = reduce(lambda x, y: x + y, [legacy_strength(m.normalizer, *value(m), F.col(f"ratio_{m.mapping_id}")) for m in used], F.lit(0.0))
    return pairs.select("candidate_id", *_PAIR, (total / len(used)).alias("mean")).select("candidate_id", *_PAIR, S.rounded(F.col("mean")).alias("score"), F.lit(0).alias("agreements"), F.lit(False).alias("contradiction"))


METRICS = (
    "candidate_reduction_ratio", "candidate_recall", "feature_scoring_coverage", "retained_link_coverage", "auto_match_precision", "auto_match_recall", "review_rate", "end_to_end_recovery", "top1_true_candidate_rate"
)


def snapshot_metrics(ranked: DataFrame, kept: DataFrame, truth: DataFrame, theoretical: int) -> DataFrame:
    """metric, numerator, denominator, value (null over nothing) of a match; every pair carries its stages as bits."""
    bit = lambda df, n: df.select(*_PAIR, F.lit(n).alias("bit"))
    first = ranked.where("rank = 1")
    parts = [bit(truth, 1), bit(ranked, 2), bit(kept, 4), bit(first.where("band = 'auto_match'"), 8), bit(first, 16)]
    tagged = reduce(DataFrame.union, parts).groupBy(*_PAIR).agg(F.bit_or("bit").alias("bits"))
    has = lambda *bits: reduce(lambda x, y: x & y, [F.col("bits").bitwiseAND(F.lit(b)) != 0 for b in bits])
    pairs = tagged.agg(*[F.count_if(has(*bits)).alias(name) for name, bits in {"truth": (1,), "found": (2,), "found_true": (1, 2), "kept_true": (1, 4), "auto": (8,), "auto_true": (1, 8), "top_true": (1, 16)}.items()])
    rows = tagged.groupBy("a_row_id").agg(F.bit_or("bits").alias("bits"), F.bool_or(has(1, 2)).alias("reached")).agg(
        F.count_if(has(1)).alias("matchable"), F.count_if(has(1, 4) & ~has(8)).alias("reviewed"), F.count_if("reached").alias("eligible")
    )
    row = pairs.crossJoin(rows)  # one row each
    c, all_pairs = F.col, F.lit(theoretical).cast("long")
    sides = [
        (all_pairs - c("found"), all_pairs), (c("found_true"), c("truth")), (c("found_true"), c("found_true")), (c("kept_true"), c("found_true")), (c("auto_true"), c("auto")), (c("auto_true"), c("truth")), (c("reviewed"), c("matchable")),
        (c("kept_true"), c("truth")), (c("top_true"), c("eligible")),
    ]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), n.alias("numerator"), d.alias("denominator"), _ratio(n, d).alias("value")) for m, (n, d) in zip(METRICS, sides, strict=True)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


# What two snapshots must have in common, and what a difference is called.
KEYS = {
    "source_type": "label source type", "source_id": "fixture or label-set identity", "dataset_fingerprints": "dataset fingerprints",
    "candidate_engine": "candidate engine version", "candidate_config": "candidate configuration", "evaluation_version": "evaluation semantics",
}


def snapshot_id(metrics: DataFrame, keys: Dict[str, str], matcher: str) -> str:
    """A name that follows from a snapshot's content."""
    rows = sorted((r.metric, r.numerator, r.denominator) for r in metrics.collect())  # nine
    return f"evaluation-{canonical_hash([rows, dict(keys), matcher])[:16]}"


def differences(left: Dict[str, str], right: Dict[str, str]) -> list[str]:
    """Why two snapshots can't be compared; none if they can."""
    if set(left) != set(KEYS) or set(right) != set(KEYS):
        raise Invalid("a snapshot must have all six compatibility keys")
    return [f"Different {name}." for k, name in KEYS.items() if left[k] != right[k]]


def compared(left: DataFrame, right: DataFrame, left_keys: Dict[str, str], right_keys: Dict[str, str]) -> DataFrame:
    """Metrics of two snapshots side by side; a delta only where they are compatible and both have a value."""
    reasons = differences(left_keys, right_keys)
    both = left.select("metric", F.col("value").alias("version_a")).join(right.select("metric", F.col("value").alias("version_b")), "metric")
    delta = F.lit(None).cast("double") if reasons else F.round(F.col("version_b") - F.col("version_a"), 9)
    return both.select("metric", "version_a", "version_b", delta.alias("delta"), F.lit(not reasons).alias("compatible"), F.lit(" ".join(reasons)).alias("reasons"))


def check_holdout(frozen: bool, tuned_on: str, fixture: str) -> None:
    """A holdout is scored only by a frozen configuration that was tuned on another fixture."""
    if not frozen:
        raise Invalid("holdout evaluation needs a frozen configuration")
    if tuned_on == fixture:
        raise Invalid("the holdout fixture can't be the tuning fixture")
