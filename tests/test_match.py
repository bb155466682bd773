"""Pinned examples of the match, on a few rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.functions.similarity import matched, rounded
from weftlink.operators import blocking, compare, decide, survive
from weftlink.plans.match import Match
from weftlink.plans.model import CandidateConfig, FieldPolicy, Invalid, Mapping, Rules, build_policy, check_headers, check_mappings, infer_family

NAME, PHONE, EMAIL = Mapping("name", "name", "name", "name_or_title"), Mapping("phone", "phone", "phone", "phone"), Mapping("email", "email", "email", "email")


def rows(spark, side, *values, columns=("name", "phone", "email")):
    return spark.createDataFrame([(f"{side}{i + 1}", *v) for i, v in enumerate(values)], ["row_id", *columns])


def evidence(spark, m, left, right):
    a, b = (blocking.prepared(rows(spark, s, (v,), columns=(m.a_column,)), s, [m]) for s, v in (("A", left), ("B", right)))
    pair = spark.createDataFrame([("A1", "B1", "c")], ["a_row_id", "b_row_id", "candidate_id"])
    r = compare.evidence(compare.joined(pair, a, b), [m]).first()
    i = m.mapping_id
    return r[f"class_{i}"], r[f"positive_{i}"], r[f"conflict_{i}"], r[f"plus_{i}"], r[f"minus_{i}"]


def test_pinned_comparisons(spark):
    assert evidence(spark, NAME, "northstar medical group", "northstar medical supply") == ("partial_agreement", 0.682979, 0.0, 1.365958, 0.0)
    address = Mapping("address", "address", "address", "address")
    assert evidence(spark, address, "100 Market Street", "110 Market St") == ("conflict", 0.455769, 1.0, 0.683653, 0.3)
    assert evidence(spark, address, "100 Market St", "100 Market")[:3] == ("partial_agreement", 0.884058, 0.04058)
    assert evidence(spark, Mapping("city", "city", "city", "geography"), "Portland", "Portlands")[:3] == ("conflict", 0.470588, 1.0)
    assert evidence(spark, Mapping("ref", "ref", "ref", "persistent_identifier"), "a", "b")[4] == 2.5


def test_scores_and_bands(spark):
    a = rows(spark, "A", ("Acme Inc", "555-010-9999", ""), ("Zebra Foods", "555-777-1234", ""))
    b = rows(spark, "B", ("Acme", "5550109999", ""), ("Zebra Foods", "555-777-0000", ""))
    m = Match(a, b, [NAME, PHONE])
    got = {(r.a_row_id, r.b_row_id): (r.score, r.band) for r in m.ranked.collect()}
    assert got == {("A1", "B1"): (1.0, "auto_match"), ("A2", "B2"): (0.507143, "needs_review")}
    assert [r.a_row_id for r in m.automatic.collect()] == ["A1"]


def test_shared_b_is_never_linked(spark):
    kept = spark.createDataFrame([("c1", "A1", "B1", 1, "auto_match", False), ("c2", "A2", "B1", 3, "needs_review", False), ("c3", "A3", "B3", 1, "auto_match", False)], "candidate_id string, a_row_id string, b_row_id string, rank int, band string, collision boolean")
    assert [r.candidate_id for r in decide.conservative(kept).collect()] == ["c3"]
    assert sorted(r.candidate_id for r in decide.legacy(kept).collect()) == ["c1", "c3"]
    with pytest.raises(Invalid):
        decide.automatic(kept, "unknown-policy")


@pytest.mark.parametrize("n_a, n_b, suppressed", [(21, 1, True), (11, 10, True), (10, 10, False)])
def test_bucket_limits(spark, n_a, n_b, suppressed):
    keys = lambda s, n: spark.range(n).select(F.concat(F.lit(s), "id").alias("row_id"), F.lit("exact_strong_v1").alias("blocker_id"), F.lit("k").alias("key"))
    a, b = keys("A", n_a), keys("B", n_b)
    counted = blocking.buckets(a, b)
    assert counted.first().suppressed is suppressed
    assert blocking.relationships(a, b, counted).count() == (0 if suppressed else n_a * n_b)


def test_normalizers(spark):
    df = spark.createDataFrame([("1 (555) 010-9999", "Me@Ex.com ", "https://u@www.Ex.com:80/x", "The  ACME Co. Ltd", "12 Main Street"), (None,) * 5], "p string, e string, d string, n string, a string")
    got = df.select(N.phone(F.col("p")), N.email(F.col("e")), N.domain(F.col("d")), N.name(F.col("n")), N.address(F.col("a")), N.address_number(N.address(F.col("a")))).collect()
    assert tuple(got[0]) == ("5550109999", "me@ex.com", "ex.com", "the acme", "12 main st", "12")
    assert tuple(got[1]) == ("",) * 6


def test_unicode_folding(spark):
    assert spark.createDataFrame([("Straße Ⅳ",)], "v string").select(N.text(N.folded(F.col("v")), unicode=True)).first()[0] == "strasse iv"


def test_instants(spark):
    values = ["2025-02-30", "2025-02-28", "2025-02-28T00:00:00Z", "2025-02-28T01:00:00+01:00", "2025-02-28T00:00:00", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(N.instant(F.col("v"))).collect()]
    assert got == [None, 1740700800000, 1740700800000, 1740700800000, None, None, None]


def test_survivorship(spark):
    found = spark.createDataFrame([("x1", "c1", "A1", "B1", "phone", " ", "x"), ("x2", "c1", "A1", "B1", "email", "NULL", "x"), ("x3", "c1", "A1", "B1", "name", "p", "q")], "conflict_id string, candidate_id string, a_row_id string, b_row_id string, mapping_id string, a_value string, b_value string")
    policy = build_policy([FieldPolicy("phone", "prefer_non_null"), FieldPolicy("email", "prefer_non_null"), FieldPolicy("name", "keep_both")], [NAME, PHONE, EMAIL])
    kept = spark.createDataFrame([("x3", "A", "manual")], "conflict_id string, chosen string, origin string")
    got = {r.conflict_id: (r.chosen, r.reason) for r in survive.preview(found, policy, kept).collect()}
    assert got == {"x1": ("B", "non_null_b"), "x2": (None, "both_present"), "x3": ("A", "manual_preserved")}
    previewed = survive.preview(found, policy)
    assert survive.applied(previewed, survive.state_token(previewed)).count() == 2
    with pytest.raises(Invalid):
        survive.applied(previewed, "stale")


def test_plan_checks():
    with pytest.raises(Invalid):
        check_mappings([Mapping("x", "a", "b", matching=False)], ["a"], ["b"])
    with pytest.raises(Invalid):
        check_headers(["id", "Entity_ID"], ["entity_id"])
    pinned = {"contact_email": "contact_person", "work_e-mail": "email", "source_key": "source_local_identifier", "owner": "unknown", "owner_name": "contact_person", "zip": "geography", "web_site": "domain", "vendor": "name_or_title", "notes": "free_text", "cust_no": "unknown", "statement": "unknown"}
    assert {c: infer_family(Mapping("m", c, "x")) for c in pinned} == pinned
    assert Mapping("m", "zip_code", "postal").kind == "postal"
    assert Mapping("m", "zip_code", "postal", "unknown").kind == "unknown"


def test_order_of_rows_changes_nothing(spark):
    values = [(f"Acme {i} Foods", f"555-010-{1000 + i}", f"u{i}@ex.com") for i in range(12)]
    a, b = rows(spark, "A", *values), rows(spark, "B", *values)
    one = sorted(map(tuple, Match(a, b, [NAME, PHONE, EMAIL]).ranked.select("candidate_id", "score", "rank", "band").collect()))
    two = sorted(map(tuple, Match(a.repartition(5), b.orderBy(F.desc("row_id")), [NAME, PHONE, EMAIL], CandidateConfig(), Rules()).ranked.select("candidate_id", "score", "rank", "band").collect()))
    assert one == two and len(one) > 0


def test_matching_blocks_are_those_of_difflib():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abc d日ü\x00") for _ in range(rng.choice([0, 1, 5, 30, 60])))
    pairs = [(text(), text()) for _ in range(800)] + [("ab" * 400, "ba" * 300), ("", ""), ("x" * 300, "x" * 299)]
    expected = [sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]
    assert matched(*map(list, zip(*pairs, strict=True))).tolist() == expected


def test_all_pairs_are_ranked_without_their_values(spark):
    """What is written, ranked and shuffled for all pairs holds scores; values and evidence come with the kept ones."""
    m = Match(rows(spark, "A", ("Acme Foods Inc", "555-010-9999", "")), rows(spark, "B", ("Acme Foods", "5550109999", "")), [NAME, PHONE])
    assert {"score", "agreements", "contradiction"} <= set(m.ranked.columns)
    assert not [c for c in m.ranked.columns if c.startswith(("a_v_", "a_n_", "class_", "ratio_")) or c == "blocking_evidence"]
    assert {(r.mapping_id, r.a_value, r["class"]) for r in m.fields.collect()} == {("name", "Acme Foods Inc", "exact_agreement"), ("phone", "555-010-9999", "exact_agreement")}


def test_a_value_is_split_once_for_each_pair(spark):
    pair = spark.createDataFrame([("c", "A1", "B1", "acme foods", "acme labs")], "candidate_id string, a_row_id string, b_row_id string, a_n_name string, b_n_name string")
    plan = compare.evidence(pair, [NAME])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4  # two values, each for its own size and for what both have


def test_rounding_is_pythons_near_ties_and_away(spark):
    values = [n / 1e6 + d for n in (0, 1, 2, 123456, 682979, 2499999) for d in (0.0, 5e-7, -5e-7, 4.999999e-7, 5.000001e-7, 1e-7)] + [0.1234565, 0.1234575, -0.3333335, 1e9 + 0.0000005, 12345.6789125]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded(F.col("x")).alias("r")).collect()
    assert [r.r for r in got] == [round(r.x, 6) for r in got]
