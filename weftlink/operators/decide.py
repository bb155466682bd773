"""Ranking, bands and one-to-one assignment of scored pairs, with windows and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.similarity import bounded, rounded
from weftlink.plans.model import Invalid, Rules, check_policy


def ranked(scored: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds rank, margin, collision (both on rank 1 only) and band."""
    by_a = Window.partitionBy("a_row_id").orderBy(F.desc("score"), "b_row_id")
    out = scored.withColumn("rank", F.row_number().over(by_a)).withColumn("next", F.lead("score").over(by_a))
    first = F.col("rank") == 1
    out = out.withColumn("margin", F.when(first, bounded(F.col("score") - F.coalesce("next", F.lit(0.0)))).otherwise(0.0)).drop("next")
    wanted = (first & (F.col("score") >= rules.review)).cast("int")
    out = out.withColumn("wanted_by", F.sum(wanted).over(Window.partitionBy("b_row_id")))
    out = out.withColumn("collision", first & (F.col("wanted_by") > 1) & (F.col("score") >= rules.review)).drop("wanted_by")
    auto = (F.col("score") >= rules.auto) & (F.col("margin") >= rules.margin) & ~F.col("collision")
    if rules.gate_agreements:
        auto &= F.col("agreements") >= rules.agreements
    if rules.gate_contradictions:
        auto &= ~F.col("contradiction")
    return out.withColumn("band", F.when(first & auto, "auto_match").otherwise("needs_review"))


def retained(ranks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The best pairs of each A row that stand for review: near enough to its top, at most a few."""
    top = F.max("score").over(Window.partitionBy("a_row_id"))
    near = F.col("score") >= F.greatest(F.lit(rules.floor), rounded(F.col("top") - rules.window))
    return ranks.withColumn("top", top).where((F.col("top") >= rules.review) & near & (F.col("rank") <= rules.alternatives)).drop("top")


def only_a(a: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of A without a pair worth a review."""
    return a.select("row_id").join(kept.select(F.col("a_row_id").alias("row_id")), "row_id", "left_anti")


def only_b(b: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of B in no automatic pair."""
    return b.select("row_id").join(kept.where("band = 'auto_match' AND rank = 1").select(F.col("b_row_id").alias("row_id")), "row_id", "left_anti")


def conservative(kept: DataFrame) -> DataFrame:
    """Automatic first-rank pairs without collision whose B no other A row keeps in any rank."""
    owners = kept.groupBy("b_row_id").agg(F.count_distinct("a_row_id").alias("owners"))
    first = kept.where("rank = 1 AND band = 'auto_match'")
    claims = first.groupBy("a_row_id").agg(F.count("*").alias("claims"))
    return first.where("NOT collision").join(owners, "b_row_id").join(claims, "a_row_id").where("owners = 1 AND claims = 1").drop("owners", "claims")


def legacy(kept: DataFrame) -> DataFrame:
    return kept.where("rank = 1 AND band = 'auto_match'")


def automatic(kept: DataFrame, policy: str = "assignment-one-to-one-conservative-v1") -> DataFrame:
    """The pairs that a policy links without a person."""
    return legacy(kept) if check_policy(policy) == "assignment-legacy-v1" else conservative(kept)


def violations(kept: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of either side that more than one SAME decision claims, with the claiming candidates."""
    same = kept.join(decisions.where("decision = 'same_entity'").select("candidate_id"), "candidate_id", "left_semi")
    claims = same.select(F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("a_row_id").alias("row_id")), F.struct(F.lit("B").alias("side"), F.col("b_row_id").alias("row_id")))).alias("x"), "candidate_id").select("x.*", "candidate_id")
    found = claims.groupBy("side", "row_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("candidate_id")), ",").alias("candidates")).where("n > 1")
    return found.withColumn("code", F.lit("one_to_one_integrity_violation"))


def checked_links(kept: DataFrame, auto: DataFrame, decisions: DataFrame) -> DataFrame:
    """The effective links; refuses decisions that claim a row twice, or name a candidate that isn't kept."""
    if not violations(kept, decisions).isEmpty():
        raise Invalid("one_to_one_integrity_violation: a row is in more than one confirmed link")
    if not decisions.where("decision = 'same_entity'").join(kept.select("candidate_id"), "candidate_id", "left_anti").isEmpty():
        raise Invalid("one_to_one_integrity_violation: a confirmed candidate isn't in the match")
    return effective_links(kept, auto, decisions)


def effective_links(kept: DataFrame, auto: DataFrame, decisions: DataFrame) -> DataFrame:
    """People's SAME decisions first, then automatic pairs that they neither rejected nor took a side of.

    decisions: candidate_id, decision (same_entity or different_entity), current ones only.
    """
    same = decisions.where("decision = 'same_entity'").select("candidate_id")
    human = kept.join(same, "candidate_id", "left_semi").select("candidate_id", "a_row_id", "b_row_id", F.lit("human").alias("source"))
    rejected = decisions.where("decision = 'different_entity'").select("candidate_id")
    rest = auto.select("candidate_id", "a_row_id", "b_row_id", F.lit("system_matcher").alias("source")).join(rejected, "candidate_id", "left_anti")
    rest = rest.join(human.select("a_row_id"), "a_row_id", "left_anti").join(human.select("b_row_id"), "b_row_id", "left_anti")
    return human.unionByName(rest)


def double_claims(links: DataFrame) -> DataFrame:
    """Rows of either side in more than one link; must be empty."""
    side = lambda s: links.groupBy(F.col(f"{s}_row_id").alias("row_id")).agg(F.count("*").alias("n")).where("n > 1").withColumn("side", F.lit(s.upper()))
    return side("a").unionByName(side("b"))


def contenders(kept: DataFrame, links: DataFrame, decisions: DataFrame) -> DataFrame:
    """For every B row, all A rows that keep it, in order, and what has become of each."""
    mine = links.select("candidate_id", F.lit(True).alias("linked_here"))
    elsewhere = links.select("a_row_id", F.lit(True).alias("linked"))
    rejected = decisions.where("decision = 'different_entity'").select("candidate_id", F.lit(True).alias("rejected"))
    out = kept.join(mine, "candidate_id", "left").join(elsewhere, "a_row_id", "left").join(rejected, "candidate_id", "left")
    status = F.when(F.col("linked_here"), "linked_here").when(F.col("rejected"), "rejected_pair").when(F.col("linked"), "linked_elsewhere").otherwise("unresolved")
    order = Window.partitionBy("b_row_id").orderBy("rank", F.desc("score"), "a_row_id")
    return out.withColumn("status", status).withColumn("place", F.row_number().over(order)).select("b_row_id", "place", "a_row_id", "candidate_id", "rank", "score", "status")


def margin_band(margin: Column) -> Column:
    return F.when(margin < 0.04, "near_tie").when(margin < 0.10, "narrow").otherwise("clear")
