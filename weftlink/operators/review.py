"""Review work as queries over the kept pairs and small tables of decisions and deferrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.similarity import rounded
from weftlink.plans.model import STRONG_FAMILIES, WEAK_FAMILIES

from .decide import margin_band

DEFAULT_PAGE, MOST_PAGE = 50, 100
VERSION = "review-signature-v1.0.0"


def queue(kept: DataFrame, auto: DataFrame, decisions: DataFrame, deferrals: DataFrame) -> DataFrame:
    """One item for each A row that needs a person, with its state and current pair.

    decisions: candidate_id, decision; deferrals: a_row_id, deferred; current ones only.
    """
    known = kept.join(decisions.select("candidate_id", "decision"), "candidate_id", "left")
    pick = F.when(F.col("decision") == "same_entity", 0).when(F.col("decision").isNull(), 1).otherwise(2)
    items = known.groupBy("a_row_id").agg(
        F.min_by(F.struct("candidate_id", "b_row_id", "rank", "score", "margin", "collision", "contradiction"), F.struct(pick, "rank")).alias("current"),
        F.count("*").alias("candidates"), F.bool_or(F.col("decision") == "same_entity").alias("same"), F.bool_and(F.col("decision") == "different_entity").alias("all_different"), F.count("decision").alias("decided"),
        F.max(F.when(F.col("rank") == 1, F.col("margin"))).alias("top_margin"),
    )
    untouched = items.where("decided > 0").select("a_row_id").union(deferrals.where("deferred").select("a_row_id"))
    silent = auto.select("a_row_id").join(untouched, "a_row_id", "left_anti")
    out = items.join(silent, "a_row_id", "left_anti").join(deferrals.select("a_row_id", "deferred"), "a_row_id", "left")
    state = F.when(F.coalesce("same", F.lit(False)), "reviewed_same").when(F.coalesce("all_different", F.lit(False)), "reviewed_different").when(F.coalesce("deferred", F.lit(False)), "deferred").otherwise("needs_review")
    shared = kept.groupBy("b_row_id").agg(F.count_distinct("a_row_id").alias("owners"))
    flat = out.withColumn("state", state).select("a_row_id", "state", "candidates", "top_margin", "current.*")
    return flat.join(shared, "b_row_id").withColumn("collision", F.col("collision") | (F.col("owners") > 1)).drop("owners")


def peers(kept: DataFrame, items: DataFrame) -> DataFrame:
    """For each item the other A rows that keep its current B, sorted."""
    others = kept.select("b_row_id", F.col("a_row_id").alias("other")).distinct()
    return items.select("a_row_id", "b_row_id").join(others, "b_row_id").where("other <> a_row_id").groupBy("a_row_id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("peers"))


def strongest(fields: DataFrame, per_place: int = 0) -> DataFrame:
    """Each pair's strongest supporting and contradicting field; the first mapping on ties.

    per_place: where it isn't 0, a mapping that comes later by a place must be stronger by more than 1 / per_place.
    """
    rank = lambda c: F.col(c) * per_place - F.col("place") if per_place else F.col(c)
    by = lambda c: F.max_by("mapping_id", F.when(F.col(c) > 0, F.struct(rank(c), -F.col("place"))))
    return fields.groupBy("candidate_id").agg(by("plus").alias("supporting"), by("minus").alias("contradicting"))


def signatures(items: DataFrame, fields: DataFrame) -> DataFrame:
    """Each item's evidence signature and its group id: sorted evidence of the current pair, then its situation."""
    parts = fields.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "class", "information"))), "|").alias("evidence"))
    flag = lambda name, c: F.concat(F.lit(f"{name}:"), F.coalesce(F.col(c), F.lit(False)).cast("string"))
    alternatives = F.when(F.col("candidates") > 1, "alternatives:multiple").otherwise("alternatives:single")
    text = F.concat_ws("|", F.lit(VERSION), "evidence", F.concat(F.lit("margin:"), margin_band(F.col("top_margin"))), alternatives, flag("collision", "collision"), flag("strong", "contradiction"))
    out = items.join(parts, "candidate_id").withColumn("signature", text)
    return out.withColumn("group_id", F.concat(F.lit("review-group-"), F.substring(F.sha2("signature", 256), 1, 20))).drop("evidence")


def eligibility(items: DataFrame, fields: DataFrame) -> DataFrame:
    """Whether an item may be decided with its group, as the same or as different, and what that rests on.

    Support counts as strong from a strong family, in full or part, with a positive weight on a value that isn't common.
    It is of low information if all positive weights are of weak families or of repeated or common values.
    """
    positive = F.col("plus") > 0
    agrees = F.col("class").isin("exact_agreement", "partial_agreement")
    low = F.col("kind").isin(*WEAK_FAMILIES) | F.col("information").isin("repeated", "common")
    identifier = F.col("kind") == "persistent_identifier"
    facts = fields.groupBy("candidate_id").agg(
        F.bool_or(identifier & (F.col("class") == "exact_agreement")).alias("id_agrees"), F.bool_or(identifier & (F.col("class") == "conflict")).alias("id_conflicts"),
        F.count_if(F.col("kind").isin(*STRONG_FAMILIES) & agrees & positive & (F.col("information") != "common")).alias("strong_support"),
        (F.bool_or(positive) & ~F.bool_or(positive & ~low)).alias("weak_only"),
    )
    apart = ~F.col("collision") & (F.col("top_margin") >= 0.04)
    same = apart & ~F.col("contradiction") & ~F.col("id_conflicts") & (F.col("strong_support") >= 2)
    different = apart & (F.col("candidates") == 1) & ~F.col("id_agrees") & (F.col("strong_support") < 2) & F.col("weak_only")
    return items.join(facts, "candidate_id").withColumns({"same_eligible": same, "different_eligible": different})


# Safety classes in the order of the list of groups.
SAFETY_ORDER = ("quick_decision", "competing_candidates", "strong_contradiction", "low_information_noise", "individual_review")


def groups(judged: DataFrame) -> DataFrame:
    """One row for each signature of open items: size, eligible items, a suggestion only if all are eligible, and safety class.

    A signature fixes all that the safety class asks but the eligible items, so any item of the group stands for it.
    """
    out = judged.where("state = 'needs_review'").groupBy("group_id", "signature").agg(
        F.count("*").alias("n_items"), F.count_if("same_eligible").alias("n_same"), F.count_if("different_eligible").alias("n_different"),
        F.bool_or("collision").alias("collision"), F.bool_or("contradiction").alias("contradiction"), F.bool_or("id_conflicts").alias("id_conflicts"), F.bool_or("weak_only").alias("weak_only"),
        F.min(margin_band(F.col("top_margin"))).alias("margin_band"), F.min(F.when(F.col("candidates") > 1, "multiple").otherwise("single")).alias("alternatives"),
    )
    suggested = F.when(F.col("n_same") == F.col("n_items"), "same_entity").when(F.col("n_different") == F.col("n_items"), "different_entity")
    safety = (
        F.when(F.col("collision") | (F.col("margin_band") == "near_tie"), "competing_candidates").when(F.col("id_conflicts") | F.col("contradiction"), "strong_contradiction")
        .when(F.col("weak_only"), "low_information_noise").when(suggested.isNotNull(), "quick_decision").otherwise("individual_review")
    )
    return out.select("group_id", "signature", "n_items", "n_same", "n_different", suggested.alias("suggested"), safety.alias("safety"), "margin_band", "alternatives", "collision", "contradiction")


def patterns(judged: DataFrame, fields: DataFrame) -> DataFrame:
    """Each group's kinds of evidence, with the mappings that show them, in the order of kind, class and information."""
    first = judged.where("state = 'needs_review'").groupBy("group_id").agg(F.min_by("candidate_id", "a_row_id").alias("candidate_id"))
    return first.join(fields, "candidate_id").groupBy("group_id", "kind", "class", "information").agg(F.array_join(F.array_sort(F.collect_set("mapping_id")), ",").alias("mappings"))


def ordered_groups(found: DataFrame) -> DataFrame:
    """Groups in the order of the list: safety class, size, id. There are as many as signatures, far fewer than items."""
    place = F.row_number().over(Window.orderBy(F.array_position(F.array(*map(F.lit, SAFETY_ORDER)), F.col("safety")), F.desc("n_items"), "group_id"))
    return found.withColumn("place", place)


def workload(found: DataFrame, items: DataFrame) -> DataFrame:
    """One row: open items in all and by safety class, deferred ones, and groups."""
    of = [F.coalesce(F.sum(F.when(F.col("safety") == x, F.col("n_items"))), F.lit(0)).cast("long").alias(x) for x in SAFETY_ORDER]
    return found.agg(F.coalesce(F.sum("n_items"), F.lit(0)).cast("long").alias("needs_attention"), *of, F.count("*").alias("n_groups")).crossJoin(items.agg(F.count_if(F.col("state") == "deferred").alias("deferred")))  # one row each


def group_preview(judged: DataFrame, group_id: str, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """A page of a group's open items, in the order of A's ids."""
    return page(judged.where((F.col("group_id") == group_id) & (F.col("state") == "needs_review")), ["a_row_id"], offset, limit)


# Orders of the review list.
SORTS = {
    "ambiguity": ("top_margin ASC", "score DESC"),
    "score_desc": ("score DESC",),
    "score_asc": ("score ASC",),
    "candidate_count": ("candidates DESC",),
    "source": (),
}


FILTERS = ("unresolved", "all", "deferred", "collision", "contradiction", "multiple")


def filtered(items: DataFrame, fields: DataFrame, only: str = "unresolved", search: str = "") -> DataFrame:
    """Items of a filter, and of a substring, in any case, of either id or of either side's value of kind `name`, which mappings without a family have."""
    against = fields.where("minus > 0").select("candidate_id", F.lit(True).alias("against")).distinct()
    found = items.join(against, "candidate_id", "left") if only == "contradiction" else items
    tests = {
        "unresolved": F.col("state") == "needs_review", "all": F.lit(True), "deferred": F.col("state") == "deferred", "collision": F.col("collision"), "multiple": F.col("candidates") > 1,
        "contradiction": F.col("contradiction") | F.coalesce(F.col("against") if only == "contradiction" else F.lit(False), F.lit(False)),
    }
    found = found.where(tests[only]).drop("against")
    wanted = search.strip().lower()
    if not wanted:
        return found
    names = fields.where("kind = 'name'").groupBy("candidate_id").agg(F.min_by(F.struct("a_value", "b_value"), "place").alias("name"))
    found = found.join(names, "candidate_id", "left")
    texts = [F.col("a_row_id"), F.col("b_row_id"), F.col("name.a_value"), F.col("name.b_value")]
    return found.where(F.array_max(F.array(*[F.coalesce(F.lower(t).contains(wanted), F.lit(False)) for t in texts]))).drop("name")


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """A page of a totally ordered list; a take-ordered, never a full sort."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(MOST_PAGE, limit)))


def sorted_page(items: DataFrame, sort: str = "ambiguity", offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    order = [F.expr(c.split()[0]).desc() if c.endswith("DESC") else F.expr(c.split()[0]).asc() for c in SORTS[sort]]
    return page(items, [*order, F.col("a_row_id")], offset, limit)


def progress(items: DataFrame) -> DataFrame:
    of = lambda *states: F.count_if(F.col("state").isin(*states))
    return items.agg(F.count("*").alias("total"), of("reviewed_same", "reviewed_different").alias("reviewed"), of("needs_review", "deferred").alias("remaining"), of("deferred").alias("deferred"))


def primary_summary(a: DataFrame, b: DataFrame, links: DataFrame, items: DataFrame, kept: DataFrame) -> DataFrame:
    """matched, needs_review, only_a, only_b: each A row in one of the first three; B rows under review aren't only_b."""
    open_items = items.where("state IN ('needs_review', 'deferred')")
    review = open_items.select("a_row_id").join(links.select("a_row_id"), "a_row_id", "left_anti")
    rest = a.select(F.col("row_id").alias("a_row_id")).join(links.select("a_row_id"), "a_row_id", "left_anti").join(review, "a_row_id", "left_anti")
    under = kept.join(review, "a_row_id", "left_semi").select("b_row_id")
    free = b.select(F.col("row_id").alias("b_row_id")).join(links.select("b_row_id"), "b_row_id", "left_anti").join(under, "b_row_id", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("status"), "n")
    return one(links, "matched").union(one(review, "needs_review")).union(one(rest, "only_a")).union(one(free, "only_b"))


def results(a: DataFrame, kept: DataFrame, links: DataFrame) -> DataFrame:
    """Status, shown pair and number of alternatives of every A row."""
    first = kept.where("rank = 1").select("a_row_id", "candidate_id", "b_row_id", "score")
    counts = kept.groupBy("a_row_id").agg((F.count("*") - 1).alias("alternatives"))
    linked = links.select("a_row_id", F.col("candidate_id").alias("link_id"), F.col("b_row_id").alias("link_b"))
    out = a.select(F.col("row_id").alias("a_row_id")).join(first, "a_row_id", "left").join(counts, "a_row_id", "left").join(linked, "a_row_id", "left")
    status = F.when(F.col("link_id").isNotNull(), "matched").when(F.col("candidate_id").isNotNull(), "needs_review").otherwise("only_a")
    return out.select("a_row_id", status.alias("status"), F.coalesce("link_b", "b_row_id").alias("b_row_id"), F.coalesce("alternatives", F.lit(0).cast("long")).alias("alternatives"))


def explanation(a: DataFrame, kept: DataFrame, links: DataFrame, decisions: DataFrame, automatic: DataFrame) -> DataFrame:
    """For every A row the pair that it is shown with, its link or else its first, and a code for what has become of it."""
    linked = links.select("a_row_id", F.col("candidate_id").alias("link_id"))
    shown = kept.join(linked, "a_row_id", "left").groupBy("a_row_id").agg(
        F.min_by(F.struct("candidate_id", "b_row_id", "rank", "score", "band", "link_id"), F.struct(F.coalesce(F.col("candidate_id") != F.col("link_id"), F.lit(True)), "rank", "candidate_id")).alias("x"), F.count("*").alias("candidates")
    )
    out = a.select(F.col("row_id").alias("a_row_id")).join(shown, "a_row_id", "left").select("a_row_id", "x.*", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))
    out = out.join(decisions.select("candidate_id", "decision"), "candidate_id", "left").join(automatic.select("candidate_id", F.lit(True).alias("auto")), "candidate_id", "left")
    reason = (
        F.when(F.col("candidate_id").isNull(), "no_candidate_retained").when(F.col("decision") == "different_entity", "rejected_by_human").when(F.col("decision") == "same_entity", "linked_by_human")
        .when(F.col("link_id") == F.col("candidate_id"), "linked_automatically").when(F.col("link_id").isNotNull(), "other_candidate_linked")
        .when((F.col("band") == "needs_review") | F.col("auto").isNull(), "candidate_awaiting_review").otherwise("alternative_not_selected")
    )
    return out.select("a_row_id", "candidate_id", "b_row_id", "candidates", reason.alias("reason"))


def detail(kept: DataFrame, links: DataFrame, decisions: DataFrame, items: DataFrame) -> DataFrame:
    """For each kept pair: alternatives of its A row, other A rows that keep or are linked to its B, its decision, and its item's state."""
    others = kept.select("b_row_id", F.col("a_row_id").alias("other")).distinct()
    taken = links.select("b_row_id", F.col("a_row_id").alias("other"))
    rivals = lambda df, name: kept.select("candidate_id", "a_row_id", "b_row_id").join(df, "b_row_id").where("other <> a_row_id").groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias(name))
    alternatives = kept.groupBy("a_row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))), lambda x: x["candidate_id"]), ",").alias("alternatives"))
    out = kept.select("candidate_id", "a_row_id", "b_row_id").join(alternatives, "a_row_id").join(rivals(others, "collisions"), "candidate_id", "left").join(rivals(taken, "linked_collisions"), "candidate_id", "left")
    out = out.join(decisions.select("candidate_id", "decision"), "candidate_id", "left").join(items.select("a_row_id", "state"), "a_row_id", "left")
    return out.select("candidate_id", "a_row_id", "b_row_id", "alternatives", F.coalesce("collisions", F.lit("")).alias("collisions"), F.coalesce("linked_collisions", F.lit("")).alias("linked_collisions"), "decision", F.coalesce("state", F.lit("auto_match")).alias("state"))


def conflict_page(previewed: DataFrame, links: DataFrame, status: str = "all", offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """A page of the field conflicts of linked pairs, all, unresolved or resolved, in the order of their ids."""
    rows = previewed.join(links.select("candidate_id", "a_row_id", "b_row_id"), "candidate_id")
    tests = {"all": F.lit(True), "unresolved": F.col("chosen").isNull(), "resolved": F.col("chosen").isNotNull()}
    return page(rows.where(tests[status]), ["conflict_id"], offset, limit)


def top_evidence(fields: DataFrame, most: int = 6) -> DataFrame:
    """The fields of each pair that weigh most, either way; ties go by mapping."""
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc(rounded(F.col("plus") + F.col("minus"))), "mapping_id"))
    return fields.withColumn("order", place).where(F.col("order") <= most).select("candidate_id", "order", "mapping_id", "class", "plus", "minus")


def label_evidence(decisions: DataFrame, kept: DataFrame) -> DataFrame:
    """How people's decisions agree with the bands."""
    both = decisions.join(kept.select("candidate_id", "band", "rank"), "candidate_id")
    return both.groupBy("band").agg(F.count("*").alias("decided"), F.count_if(F.col("decision") == "same_entity").alias("same"), F.round(F.avg((F.col("decision") == "same_entity").cast("double")), 6).alias("same_rate"))


def batch(judged: DataFrame, group_id: str, decision: str) -> DataFrame:
    """The decisions that a group's batch adds: its open, eligible items, with the evidence they rest on."""
    able = F.col("same_eligible") if decision == "same_entity" else F.col("different_eligible")
    return judged.where((F.col("group_id") == group_id) & (F.col("state") == "needs_review") & able).select("candidate_id", "a_row_id", "b_row_id", F.lit(decision).alias("decision"), F.lit("human_batch_rule").alias("origin"), "group_id", F.sha2("signature", 256).alias("evidence_sha256"))
