"""Where a match loses truth, and what makes its review work: retrospective views, never read by matching itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.plans.model import BLOCKERS, STRONG_FAMILIES, WEAK_FAMILIES, Invalid, Rules

from .evaluate import _PAIR, _ratio

ALL = "all"


def _listed(spark, **columns: Sequence) -> DataFrame:
    """A small fixed table."""
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, list(columns)) if rows else spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))


# Truth by the strength of what its rows share, and what suppression costs


def strata(truth: DataFrame, found: DataFrame, a_keys: DataFrame, b_keys: DataFrame) -> DataFrame:
    """True pairs that share an exact strong key, those that don't, and all: total, generated, missed, recall."""
    strong = lambda keys, side: keys.where("blocker_id = 'exact_strong_v1'").select(F.col("row_id").alias(f"{side}_row_id"), "key")
    sharing = truth.join(strong(a_keys, "a"), "a_row_id").join(strong(b_keys, "b"), ["b_row_id", "key"], "left_semi").select(*_PAIR, F.lit(True).alias("strong")).distinct()
    marked = truth.join(sharing, _PAIR, "left").join(found.select(*_PAIR, F.lit(1).alias("hit")), _PAIR, "left")
    kinds = F.explode(F.array(F.when(F.col("strong"), "strong_identifier").otherwise("weak_identifier"), F.lit(ALL)))
    out = marked.select(kinds.alias("stratum"), "hit").groupBy("stratum").agg(F.count("*").alias("true_pairs"), F.count("hit").alias("retained"))
    out = _listed(truth.sparkSession, stratum=("strong_identifier", "weak_identifier", ALL)).join(out, "stratum", "left").fillna(0, ["true_pairs", "retained"])
    return out.select("stratum", "true_pairs", "retained", (F.col("true_pairs") - F.col("retained")).alias("missed"), _ratio(F.col("retained"), F.col("true_pairs")).alias("recall"))


def suppression(truth: DataFrame, found: DataFrame, a_keys: DataFrame, b_keys: DataFrame, buckets: DataFrame, blockers: Sequence[str] = BLOCKERS) -> DataFrame:
    """For each blocker and for all: true pairs with a suppressed common key, and what became of them.

    The search starts from the true pairs' own keys, so no suppressed bucket is ever expanded. rescued_by_other: generated
    by a blocker that suppressed none of the pair's keys.
    """
    held = truth.join(a_keys.select(F.col("row_id").alias("a_row_id"), "blocker_id", "key"), "a_row_id")
    held = held.join(b_keys.select(F.col("row_id").alias("b_row_id"), "blocker_id", "key"), ["b_row_id", "blocker_id", "key"], "left_semi")
    held = held.join(buckets.where("suppressed").select("blocker_id", "key"), ["blocker_id", "key"], "left_semi")
    pairs = held.groupBy(*_PAIR).agg(F.collect_set("blocker_id").alias("held"))
    by = found.select(*_PAIR, F.array_distinct(F.transform("blocking_evidence", lambda e: e["blocker_id"])).alias("found_by"))
    pairs = pairs.join(by, _PAIR, "left").withColumn("other", F.size(F.array_except("found_by", "held")) > 0)
    counted = pairs.select(F.explode(F.concat("held", F.array(F.lit(ALL)))).alias("blocker_id"), "found_by", "other").groupBy("blocker_id").agg(
        F.count("*").alias("affected"), F.count("found_by").alias("rescued"), F.count_if(F.coalesce("other", F.lit(False))).alias("rescued_by_other"), F.count_if(F.col("found_by").isNull()).alias("missed")
    )
    totals = buckets.where("suppressed").select(F.explode(F.array("blocker_id", F.lit(ALL))).alias("blocker_id"), (F.col("n_a") * F.col("n_b")).alias("n")).groupBy("blocker_id").agg(F.count("*").alias("keys_suppressed"), F.sum("n").alias("relationships_suppressed"))
    return _listed(truth.sparkSession, blocker_id=(*blockers, ALL)).join(counted, "blocker_id", "left").join(totals, "blocker_id", "left").fillna(0)


# Hard negatives: pairs that look alike and are not


def hard_negatives(a_truth: DataFrame, b_truth: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of both sides of related entities, both ways round. patterns: place, left_entity, right_entity, pattern; the last place holds."""
    ways = [patterns.select((F.col("place") * 2 + i).alias("place"), F.col(x).alias("x"), F.col(y).alias("y"), "pattern") for i, (x, y) in enumerate((("left_entity", "right_entity"), ("right_entity", "left_entity")))]
    both = ways[0].union(ways[1])
    rows = both.join(a_truth.select(F.col("row_id").alias("a_row_id"), F.col("entity_id").alias("x")), "x").join(b_truth.select(F.col("row_id").alias("b_row_id"), F.col("entity_id").alias("y")), "y")
    return rows.groupBy(*_PAIR).agg(F.max_by("pattern", "place").alias("pattern"))


def hard_outcomes(hard: DataFrame, ranked: DataFrame) -> DataFrame:
    """What became of each hard negative; those never generated have nulls."""
    of = ranked.select(*_PAIR, F.lit(True).alias("hit"), "score", "rank", (F.col("rank") == 1).alias("is_top"), ((F.col("rank") == 1) & (F.col("band") == "auto_match")).alias("auto_matched"))
    return hard.join(of, _PAIR, "left").select(*_PAIR, "pattern", F.coalesce("hit", F.lit(False)).alias("generated"), "score", "rank", "is_top", "auto_matched")


def hard_coverage(hard: DataFrame, found: DataFrame, blockers: Sequence[str] = BLOCKERS) -> DataFrame:
    """For all patterns and each, known and generated pairs, coverage, and how many of them each blocker generated."""
    by = found.select(*_PAIR, F.array_distinct(F.transform("blocking_evidence", lambda e: e["blocker_id"])).alias("by"))
    out = hard.join(by, _PAIR, "left").withColumn("pattern", F.explode(F.array("pattern", F.lit(ALL)))).groupBy("pattern").agg(
        F.count("*").alias("known"), F.count("by").alias("entered"), *[F.count_if(F.coalesce(F.array_contains("by", b), F.lit(False))).alias(b) for b in blockers]
    )
    return out.withColumn("coverage", _ratio(F.col("entered"), F.col("known")))


# Stages


def stage_metrics(a_rows: DataFrame, b_rows: DataFrame, truth: DataFrame, found: DataFrame, kept: DataFrame, auto: DataFrame) -> DataFrame:
    """One row: pairs and true pairs after generation, retention and assignment, and where each true pair was lost.

    Every pair carries one bit for each stage that has it; one shuffle brings the stages together. unexplained: pairs that
    a stage has and the one before it hasn't; it must be 0.
    """
    bit = lambda df, n: df.select(*_PAIR, F.lit(n).alias("bit"))
    top = kept.where("rank = 1").select(*_PAIR)
    tagged = reduce(DataFrame.union, [bit(truth, 1), bit(found, 2), bit(kept, 4), bit(auto, 8), bit(top, 16)]).groupBy(*_PAIR).agg(F.bit_or("bit").alias("bits"))
    has = lambda *bits: reduce(lambda x, y: x & y, [F.col("bits").bitwiseAND(F.lit(b)) != 0 for b in bits])
    pairs = tagged.agg(
        F.count_if(has(1)).alias("truth_pairs"), F.count_if(has(2)).alias("generated"), F.count_if(has(1, 2)).alias("generated_true"), F.count_if(has(4)).alias("retained"), F.count_if(has(1, 4)).alias("retained_true"),
        F.count_if(has(16)).alias("top"), F.count_if(has(1, 16)).alias("top_true"), F.count_if(has(8)).alias("assigned"), F.count_if(has(1, 8)).alias("assigned_true"), F.count_if((has(4) & ~has(2)) | (has(8) & ~has(4))).alias("unexplained"),
    )
    rows = tagged.groupBy("a_row_id").agg(F.bit_or("bits").alias("bits")).agg(
        F.count_if(has(1)).alias("matchable_a"), F.count_if(has(4)).alias("bearing_a"), F.count_if(has(4) & ~has(8)).alias("review_a"), F.count_if(has(1, 4) & ~has(8)).alias("review_matchable_a"), F.count_if(has(8)).alias("assigned_a")
    )
    claimed = tagged.where(has(8)).agg(F.count_distinct("b_row_id").alias("assigned_b"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    # five one-row aggregates side by side
    row = pairs.crossJoin(rows).crossJoin(claimed).crossJoin(n(a_rows, "rows_a")).crossJoin(n(b_rows, "rows_b"))
    c = F.col
    minus = lambda x, y: c(x) - c(y)
    return row.select(
        "rows_a", "rows_b", "matchable_a", "truth_pairs", "bearing_a", "generated", "generated_true", "retained", "retained_true", "top", "top_true", "assigned", "assigned_true",
        minus("truth_pairs", "generated_true").alias("lost_in_generation"), minus("generated_true", "retained_true").alias("lost_in_retention"), minus("retained_true", "assigned_true").alias("left_to_review"), "unexplained",
        _ratio(c("generated_true"), c("truth_pairs")).alias("candidate_recall"), F.round(1 - c("generated") / (c("rows_a") * c("rows_b")), 9).alias("candidate_reduction"), _ratio(c("retained_true"), c("truth_pairs")).alias("retained_recall"),
        F.round(1 - c("retained") / (c("rows_a") * c("rows_b")), 9).alias("retained_reduction"), _ratio(c("top_true"), c("top")).alias("top_precision"), minus("assigned", "assigned_true").alias("assigned_false"), _ratio(c("assigned_true"), c("assigned")).alias("auto_precision"),
        _ratio(c("assigned_true"), c("truth_pairs")).alias("auto_recall"), _ratio(c("assigned_true"), c("matchable_a")).alias("auto_row_recall"), "review_a", _ratio(c("review_a"), c("rows_a")).alias("review_rate"),
        _ratio(c("review_matchable_a"), c("matchable_a")).alias("review_rate_matchable"), minus("rows_a", "bearing_a").alias("without_retained_a"), minus("assigned", "assigned_b").alias("double_b_claims"),
    )


# Errors by group

ERROR_GROUPS = ("candidate_misses", "ranking_losses", "post_score_losses", "hard_negatives", "false_auto_matches", "false_unmatched")


def errors(truth: DataFrame, ranked: DataFrame, kept: DataFrame, hard: DataFrame) -> DataFrame:
    """All errors, in six groups that may overlap: group, kind, a_row_id, b_row_id, stage, reason, score, rank."""
    scored = ranked.select(*_PAIR, "score", "rank", "band", F.lit(True).alias("generated"))
    kept_pairs = kept.select(*_PAIR, F.lit(True).alias("kept"))
    known = truth.join(scored, _PAIR, "left").join(kept_pairs, _PAIR, "left")
    none = F.lit(None)
    row = lambda group, kind, stage, reason, score=F.col("score"), rank=F.col("rank"): [F.lit(group).alias("group"), kind.alias("kind"), *_PAIR, F.lit(stage).alias("stage"), reason.alias("reason"), score.cast("double").alias("score"), rank.cast("int").alias("rank")]
    lit = F.lit
    misses = known.where("generated IS NULL").select(*row("candidate_misses", lit("candidate_no_shared_key"), "candidate_generation", lit("True link did not reach feature scoring.")))
    best = known.where("generated").groupBy("a_row_id").agg(F.min_by(F.struct("b_row_id", "score", "rank"), "rank").alias("x")).select("a_row_id", "x.*")
    losses = best.where("rank > 1").select(*row("ranking_losses", lit("ranking_wrong_top1"), "ranking", lit("A false candidate ranked above the best true candidate.")))
    beyond = F.col("rank") > Rules().alternatives
    dropped = known.where("generated AND kept IS NULL").select(*row("post_score_losses", F.when(beyond, "retention_top_n").otherwise("retention_threshold"), "post_score_retention", F.when(beyond, "top_n_alternative_limit").otherwise("review_cutoff")))
    alike = hard.join(scored, _PAIR).select(*row("hard_negatives", lit("hard_negative_case"), "adversarial_check", F.col("pattern")))
    false = scored.where("rank = 1 AND band = 'auto_match'").join(truth, _PAIR, "left_anti").select(*row("false_auto_matches", lit("auto_match_false_positive"), "decision_policy", lit("Automatically linked pair is false in fixture truth.")))
    whole = known.groupBy("a_row_id").agg(
        F.bool_or(F.coalesce("kept", lit(False))).alias("covered"), F.min_by(F.struct("b_row_id", "score", F.coalesce("generated", lit(False)).alias("generated")), F.struct(F.coalesce("generated", lit(False)) == lit(False), "b_row_id")).alias("x")
    ).where("NOT covered").select("a_row_id", "x.*")
    uncovered = whole.select(
        F.lit("false_unmatched").alias("group"), F.when(F.col("generated"), "unmatched_decision_policy").otherwise("unmatched_candidate_miss").alias("kind"), *_PAIR,
        F.when(F.col("generated"), "decision_coverage").otherwise("candidate_generation").alias("stage"), lit("Matchable A row has no true pair retained for decision coverage.").alias("reason"), "score", none.cast("int").alias("rank"),
    )
    return reduce(DataFrame.unionByName, [misses, losses, dropped, alike, false, uncovered])


def error_counts(found: DataFrame) -> DataFrame:
    """Errors of each group, also where there are none, and the A rows they touch."""
    counted = found.groupBy("group").agg(F.count("*").alias("errors"), F.count_distinct("a_row_id").alias("a_rows"))
    return _listed(found.sparkSession, group=ERROR_GROUPS).join(counted, "group", "left").fillna(0)


def error_page(found: DataFrame, group: str | None = None, most: int = 10) -> DataFrame:
    """The first errors of a group, or of each, with their numbers. The window is limited group by group before its shuffle."""
    if group is not None and group not in ERROR_GROUPS:
        raise Invalid(f"no error group {group}")
    rows = found if group is None else found.where(F.col("group") == group)
    number = F.row_number().over(Window.partitionBy("group").orderBy(*_PAIR))
    return rows.withColumn("number", number).where(F.col("number") <= most)


# Review demand

CAUSES = ("multiple_rank_one_automatic_proposals", "no_rank_one_candidate", "matcher_needs_review", "matcher_collision_hint", "shared_b_candidate", "other_assignment_guard")
TRUTH_CLASSES = ("no_cross_source_identity", "unique_cross_source_identity", "duplicated_cross_source_identity")
EVIDENCE = ("no_cross_source_identity", "top_rank_true", "retained_true_alternative", "generated_true_not_retained", "true_not_generated")
GATES = ("below_auto_score_threshold", "below_minimum_top_margin", "strong_contradiction", "matcher_collision_flag", "no_observable_blocker")


def demand_rows(a_truth: DataFrame, b_truth: DataFrame, found: DataFrame, kept: DataFrame, auto: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """For every A row: automatic, reviewed, truth_class and, if reviewed, cause, evidence and the gates that show."""
    n = lambda df, name: df.groupBy("entity_id").agg(F.count("*").alias(name))
    rows = a_truth.select(F.col("row_id").alias("a_row_id"), "entity_id").join(n(a_truth, "n_a"), "entity_id", "left").join(n(b_truth, "n_b"), "entity_id", "left").fillna(0, ["n_a", "n_b"])
    entity = b_truth.select(F.col("row_id").alias("b_row_id"), F.col("entity_id").alias("b_entity"))
    owners = kept.groupBy("b_row_id").agg(F.count_distinct("a_row_id").alias("owners"))
    first = F.col("rank") == 1
    options = kept.join(entity, "b_row_id", "left").join(owners, "b_row_id").groupBy("a_row_id").agg(
        F.count_if(first).alias("firsts"), F.coalesce(F.bool_or(first & (F.col("band") == "auto_match")), F.lit(False)).alias("first_auto"), F.collect_set("b_entity").alias("kept_entities"),
        F.min_by(F.when(first, F.struct("b_entity", "score", "margin", "band", "collision", "contradiction", "owners")), F.when(first, F.col("b_row_id"))).alias("top"),
    )
    generated = found.select(*_PAIR).join(entity, "b_row_id").select("a_row_id", F.col("b_entity").alias("entity_id"), F.lit(True).alias("generated_true")).distinct()
    out = rows.join(options, "a_row_id", "left").join(generated, ["a_row_id", "entity_id"], "left").join(auto.select("a_row_id", F.lit(True).alias("automatic")), "a_row_id", "left")
    out = out.withColumns({"automatic": F.coalesce("automatic", F.lit(False)), "bearing": F.col("firsts").isNotNull()}).withColumn("reviewed", F.col("bearing") & ~F.col("automatic"))
    truth_class = F.when(F.col("n_b") == 0, TRUTH_CLASSES[0]).when((F.col("n_b") > 1) | (F.col("n_a") > 1), TRUTH_CLASSES[2]).otherwise(TRUTH_CLASSES[1])
    top = lambda c: F.col(f"top.{c}")
    cause = (
        F.when((F.col("firsts") > 1) & F.col("first_auto"), CAUSES[0]).when(F.col("firsts") == 0, CAUSES[1]).when(top("band") == "needs_review", CAUSES[2])
        .when(top("collision"), CAUSES[3]).when(top("owners") > 1, CAUSES[4]).otherwise(CAUSES[5])
    )
    evidence = (
        F.when(F.col("n_b") == 0, EVIDENCE[0]).when(top("b_entity") == F.col("entity_id"), EVIDENCE[1]).when(F.array_contains("kept_entities", F.col("entity_id")), EVIDENCE[2])
        .when(F.col("generated_true"), EVIDENCE[3]).otherwise(EVIDENCE[4])
    )
    out = out.select("a_row_id", "bearing", "automatic", "reviewed", truth_class.alias("truth_class"), F.when(F.col("reviewed"), cause).alias("cause"), F.when(F.col("reviewed"), evidence).alias("evidence"), "top")
    tests = [top("score") < rules.auto, top("margin") < rules.margin, top("contradiction"), top("collision")]
    shown = F.array_compact(F.array(*[F.when(t, g) for t, g in zip(tests, GATES, strict=False)]))
    gates = F.when(F.col("cause") == CAUSES[2], F.when(F.size(shown) == 0, F.array(F.lit(GATES[4]))).otherwise(shown)).otherwise(F.array().cast("array<string>"))
    return out.withColumn("gates", gates).drop("top")


def demand(rows: DataFrame) -> DataFrame:
    """section, key, other, n: all counts and cross-tabs of the review demand, zeros too, from one pass over the A rows.

    Gates overlap, so their counts add up to nothing; all else must reconcile (`reconciled`).
    """
    cell = lambda section, key, other=F.lit(""), when=F.lit(True): F.when(when, F.struct(F.lit(section).alias("section"), key.alias("key"), other.alias("other")))
    c, reviewed = F.col, F.col("reviewed")
    cells = F.array(
        cell("denominator", F.lit("source_a_rows")), cell("denominator", F.lit("candidate_bearing_a_rows"), when=c("bearing")), cell("denominator", F.lit("automatic_a_rows"), when=c("automatic")),
        cell("denominator", F.lit("review_routed_a_rows"), when=reviewed), cell("denominator", F.lit("matchable_a_rows"), when=c("truth_class") != TRUTH_CLASSES[0]), cell("denominator", F.lit("no_retained_candidate_a_rows"), when=~c("bearing")),
        cell("cause", c("cause"), when=reviewed), cell("truth_class", c("truth_class"), when=reviewed), cell("truth_evidence", c("evidence"), when=reviewed),
        cell("cause_by_truth_class", c("cause"), c("truth_class"), reviewed), cell("cause_by_truth_evidence", c("cause"), c("evidence"), reviewed), cell("no_candidate_by_truth_class", c("truth_class"), when=~c("bearing")),
    )
    flags = F.transform("gates", lambda g: F.struct(F.lit("gate").alias("section"), g.alias("key"), F.lit("").alias("other")))
    counted = rows.select(F.explode(F.concat(F.array_compact(cells), flags)).alias("x")).select("x.*").groupBy("section", "key", "other").agg(F.count("*").alias("n"))
    full = (
        [("denominator", x, "") for x in ("source_a_rows", "candidate_bearing_a_rows", "automatic_a_rows", "review_routed_a_rows", "matchable_a_rows", "no_retained_candidate_a_rows")]
        + [("cause", x, "") for x in CAUSES] + [("truth_class", x, "") for x in TRUTH_CLASSES] + [("truth_evidence", x, "") for x in EVIDENCE] + [("gate", x, "") for x in GATES]
        + [("cause_by_truth_class", x, y) for x in CAUSES for y in TRUTH_CLASSES] + [("cause_by_truth_evidence", x, y) for x in CAUSES for y in EVIDENCE] + [("no_candidate_by_truth_class", x, "") for x in TRUTH_CLASSES]
    )
    return rows.sparkSession.createDataFrame(full, "section string, key string, other string").join(counted, ["section", "key", "other"], "left").fillna(0, ["n"])


def reconciled(counts: DataFrame) -> DataFrame:
    """The same counts; refuses them where causes, classes or evidence don't add up to the reviewed rows."""
    sums: dict[str, int] = {}
    of: dict[str, int] = {}
    for r in counts.collect():  # a fixed number of rows
        sums[r.section] = sums.get(r.section, 0) + r.n
        if r.section == "denominator":
            of[r.key] = r.n
    parts = ("cause", "truth_class", "truth_evidence", "cause_by_truth_class", "cause_by_truth_evidence")
    if any(sums.get(p) != of["review_routed_a_rows"] for p in parts) or of["review_routed_a_rows"] + of["automatic_a_rows"] != of["candidate_bearing_a_rows"]:
        raise Invalid("review demand decomposition did not reconcile")
    return counts


def demand_examples(rows: DataFrame, most: int = 5) -> DataFrame:
    """The first A rows of each cause."""
    place = F.row_number().over(Window.partitionBy("cause").orderBy("a_row_id"))
    return rows.where("reviewed").withColumn("place", place).where(F.col("place") <= most).select("cause", "place", "a_row_id")


# Review workload

SCORE_EDGES, MARGIN_EDGES = (0.0, 0.25, 0.35, 0.5, 0.7, 1.000001), (0.0, 0.02, 0.04, 0.10, 1.000001)


def band(value: Column, edges: Sequence[float]) -> Column:
    """The edges' band that holds a value; beyond them the last."""
    name = lambda x, y: f"{x:.2f}-{y:.2f}"
    out = F.lit(name(*edges[-2:]))
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((value >= low) & (value < high), name(low, high)).otherwise(out)
    return out


def cases(ranked: DataFrame, kept: DataFrame, fields: DataFrame, truth: DataFrame) -> DataFrame:
    """A rows whose first pair isn't automatic, with truth, evidence signature, and whether a group may decide them."""
    marked = ranked.select(*_PAIR, "rank").join(truth.withColumn("yes", F.lit(True)), _PAIR).groupBy("a_row_id").agg(F.min("rank").alias("true_rank"))
    best = kept.join(truth.withColumn("yes", F.lit(True)), _PAIR, "left").groupBy("a_row_id").agg(
        F.min_by(F.struct("candidate_id", "b_row_id", "score", "margin", "band", "collision", "contradiction", F.coalesce("yes", F.lit(False)).alias("top_true"), F.transform("blocking_evidence", lambda e: e["blocker_id"]).alias("blockers")), "rank").alias("x"),
        F.count("*").alias("candidates"), F.coalesce(F.bool_or("yes"), F.lit(False)).alias("kept_true"),
    )
    first = best.select("a_row_id", "x.*", "candidates", "kept_true").where("band <> 'auto_match'")
    positive, agrees = F.col("plus") > 0, F.col("class").isin("exact_agreement", "partial_agreement")
    low = F.col("kind").isin(*WEAK_FAMILIES) | F.col("information").isin("repeated", "common")
    identifier = F.col("kind") == "persistent_identifier"
    facts = fields.groupBy("candidate_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "kind", "class", F.coalesce("information", F.lit("unknown"))).alias("t")))), lambda x: x["t"]), "|").alias("evidence"),
        F.array_sort(F.collect_list(F.when(positive, F.col("mapping_id")))).alias("positive"), F.bool_or(identifier & (F.col("class") == "exact_agreement")).alias("id_agrees"), F.bool_or(identifier & (F.col("class") == "conflict")).alias("id_conflicts"),
        F.count_if(F.col("kind").isin(*STRONG_FAMILIES) & agrees & positive & (F.col("information") != "common")).alias("strong"), (F.bool_or(positive) & ~F.bool_or(positive & ~low)).alias("weak_only"),
    )
    out = first.join(facts, "candidate_id").join(marked, "a_row_id", "left")
    flag = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c).cast("string"))
    alternatives = F.when(F.col("candidates") > 1, "alternatives:multiple").otherwise("alternatives:single")
    signature = F.concat_ws("|", "evidence", F.concat(F.lit("margin:"), band(F.col("margin"), MARGIN_EDGES)), alternatives, flag("collision", "collision"), flag("strong", "contradiction"))
    apart = ~F.col("collision") & (F.col("margin") >= 0.04)
    same = apart & ~F.col("contradiction") & ~F.col("id_conflicts") & (F.col("strong") >= 2)
    different = apart & (F.col("candidates") == 1) & ~F.col("id_agrees") & (F.col("strong") < 2) & F.col("weak_only")
    return out.withColumns({"signature": signature, "same_eligible": same, "different_eligible": different}).drop("evidence")


def workload_groups(found: DataFrame) -> DataFrame:
    """Cases of one signature: size, eligible ones, and a decision that suits all of them."""
    out = found.groupBy("signature").agg(F.count("*").alias("cases"), F.count_if("same_eligible").alias("same_eligible"), F.count_if("different_eligible").alias("different_eligible"))
    return out.withColumn("suggested", F.when(F.col("same_eligible") == F.col("cases"), "same_entity").when(F.col("different_eligible") == F.col("cases"), "different_entity"))


def workload_distributions(found: DataFrame) -> DataFrame:
    """distribution, value, n, rate of the cases' score and margin bands, signatures, blockers and positive fields: one pass, one shuffle."""
    cell = lambda name, value: F.struct(F.lit(name).alias("distribution"), value.alias("value"))
    many = lambda name, c: F.transform(c, lambda x: cell(name, x))
    cells = F.concat(F.array(cell("score_band", band(F.col("score"), SCORE_EDGES)), cell("margin_band", band(F.col("margin"), MARGIN_EDGES)), cell("signature", F.col("signature"))), many("blocker", "blockers"), many("positive_field", "positive"))
    counted = found.select(F.explode(cells).alias("x")).select("x.*").groupBy("distribution", "value").agg(F.count("*").alias("n"))
    return counted.crossJoin(found.agg(F.count("*").alias("total"))).select("distribution", "value", "n", _ratio(F.col("n"), F.col("total")).alias("rate"))  # one row


def workload_metrics(found: DataFrame, groups: DataFrame, stages: DataFrame, ranked: DataFrame, kept: DataFrame, truth: DataFrame, only_a: DataFrame, only_b: DataFrame) -> DataFrame:
    """metric, value: what the review of a match amounts to. stages: the row of `stage_metrics`. Quantiles are exact."""
    c = F.col
    of = found.agg(
        F.count("*").alias("review_count"), F.count_if("top_true").alias("review_true_top"), F.count_if(~c("top_true")).alias("review_false_top"), F.count_if(~c("top_true") & c("kept_true")).alias("review_truth_in_alternatives"),
        F.count_if(c("true_rank").isNull()).alias("review_no_true_candidate"), F.count("true_rank").alias("with_truth"), F.count_if("collision").alias("collisions"), F.count_if(c("margin") < 0.04).alias("near_ties"),
        F.count_if("same_eligible").alias("batch_same_eligible"), F.count_if("different_eligible").alias("batch_different_eligible"), *[F.percentile("score", F.lit(p)).alias(f"score_p{int(p * 100)}") for p in (0.1, 0.5, 0.9)],
    )
    by = groups.agg(
        F.count("*").alias("review_groups"), F.coalesce(F.sum(F.when(c("suggested").isNull(), c("cases"))), F.lit(0)).alias("individual_reviews"), *[F.percentile("cases", F.lit(p)).alias(f"group_size_p{int(p * 100)}") for p in (0.5, 0.9)]
    )
    autos = kept.where("rank = 1 AND band = 'auto_match'").join(truth.withColumn("yes", F.lit(1)), _PAIR, "left").agg(F.count("*").alias("auto_matches"), F.count("yes").alias("auto_true"))
    under = kept.join(found.select("a_row_id"), "a_row_id", "left_semi").select(c("b_row_id").alias("row_id"))
    alone = lambda df, name: df.agg(F.count("*").alias(name))
    lone = alone(only_a, "only_a").crossJoin(alone(only_b, "only_b")).crossJoin(alone(only_a.join(found.select(c("a_row_id").alias("row_id")), "row_id", "left_anti"), "no_match_found_in_b")).crossJoin(alone(only_b.join(under, "row_id", "left_anti"), "no_match_found_in_a"))
    row = stages.select((c("rows_a") * c("rows_b")).alias("theoretical_pairs"), c("generated").alias("candidate_pairs"), "candidate_reduction", "candidate_recall").crossJoin(autos).crossJoin(of).crossJoin(by).crossJoin(lone)  # one row each
    row = row.withColumns({"auto_precision": _ratio(c("auto_true"), c("auto_matches")), "false_auto_matches": c("auto_matches") - c("auto_true"), "review_yield": _ratio(c("with_truth"), c("review_count"))}).drop("auto_true", "with_truth")
    cells = F.array(*[F.struct(F.lit(x).alias("metric"), c(x).cast("double").alias("value")) for x in row.columns])
    return row.select(F.explode(cells).alias("x")).select("x.*")
