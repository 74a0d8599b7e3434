"""Label statistics and co-occurrence on literals."""

from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelweave.functions.stats import two_sided_p
from labelweave.operators import cooccurrence as co
from labelweave.operators import labels as lab
from labelweave.operators import quality as q

DOCS = [["a"], ["a", "b"], ["a", "b", "c"], [], ["b", "a"], ["abcde", "a"]]


def docs_frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id int, labels array<string>")


def test_counts_ignore_empty_lists(spark):
    counts = lab.label_counts(docs_frame(spark, DOCS))
    assert {r.label: r.n for r in counts.collect()} == {"a": 5, "b": 3, "c": 1, "abcde": 1}
    assert lab.imbalance_ratio(counts).first()[0] == 5.0
    assert lab.imbalance_ratio(counts.limit(0)).first()[0] == float("inf")


def test_distinct_labels_exact_and_approximate(spark):
    df = docs_frame(spark, DOCS)
    assert lab.distinct_labels(df).first()[0] == 4
    assert lab.distinct_labels(df, approximate=True).first()[0] == 4


def test_tiers_take_thresholds(spark):
    counts = lab.label_counts(docs_frame(spark, DOCS))
    tiers = {r.label: r.tier for r in lab.with_tier(counts, 5, 3).collect()}
    assert tiers == {"a": "common", "b": "moderate", "c": "rare", "abcde": "rare"}
    row = lab.taxonomy_summary(counts, 5, 3).first()
    assert (row.total_assignments, row.singleton_count, row.common_coverage) == (10, 2, 0.5)


def test_zero_label_documents_stay(spark):
    sets = lab.label_sets(docs_frame(spark, DOCS))
    assert {r.k: r.n_docs for r in lab.labels_per_document(sets).collect()} == {0: 1, 1: 1, 2: 3, 3: 1}
    row = lab.label_cardinality_shares(sets).first()
    assert (row.n_zero, row.n_single, row.n_multi) == (1, 1, 4)


def brute_pairs(docs):
    return Counter(p for labels in docs for p in combinations(sorted(labels), 2))


def pairs_of(spark, docs):
    pairs = co.pair_counts(lab.label_sets(docs_frame(spark, docs)))
    return {(r.a, r.b): r.n for r in pairs.collect()}


def test_pairs_against_brute_force(spark):
    assert pairs_of(spark, DOCS) == brute_pairs(DOCS)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdefg"), unique=True, max_size=6), min_size=1, max_size=12))
def test_pairs_property(spark, docs):
    assert pairs_of(spark, docs) == brute_pairs(docs)


def test_prefix_pairs_against_brute_force(spark):
    names = ["Motion", "Motion to", "Motion to Dismiss", "Motion to Dismiss for X", "Mot", "Other", "M", "abc"]
    counts = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "label string, n long")
    wanted = {(s, l) for s in names for l in names if l.startswith(s) and len(l) > len(s) + 3}
    assert {(r.short, r.long) for r in co.prefix_pairs(counts).collect()} == wanted


def test_pivoted_matrix(spark):
    sets = lab.label_sets(docs_frame(spark, DOCS))
    matrix = co.top_matrix(sets, co.set_label_counts(sets), 3)
    table = {r["a"]: r["b"] for r in co.pivoted(matrix, ["b"]).collect()}
    assert table == {"a": 3, "abcde": 0, "b": 0}


def test_relation_status(spark):
    sets = lab.label_sets(docs_frame(spark, [["x", "y"]] * 19 + [["x"]] + [["z", "y"], ["z"]]))
    rel = co.relation_frame(spark, [("x", "y", "is_a"), ("z", "y", "is_a"), ("none", "y", "is_a")])
    rows = {r.child: (r.n_child, r.n_both, r.status) for r in co.relation_check(sets, rel).collect()}
    assert rows == {"x": (20, 19, "CONFIRMED"), "z": (2, 1, "NOT CONFIRMED"), "none": (0, 0, "NOT CONFIRMED")}


def test_t_test_known_values(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, False), (9, False)], "v int, g boolean")
    row = q.with_p_value(q.t_test(df, F.col("v"), F.col("g"))).first()
    assert row.dof == 4
    assert row.t == pytest.approx(-2.4494897, abs=1e-6)
    assert row.p_value == pytest.approx(0.0704840, abs=1e-5)


@pytest.mark.parametrize("t, dof", [(0.0, 3), (0.5, 1), (2.0, 10), (1.7, 200), (-3.2, 25)])
def test_p_value_against_integration(t, dof):
    import math

    norm = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    n, width = 20000, abs(t) / 20000
    density = lambda x: norm * (1 + x * x / dof) ** (-(dof + 1) / 2)
    inside = sum(density((i + 0.5) * width) for i in range(n)) * width
    assert two_sided_p(t, dof) == pytest.approx(1 - 2 * inside, abs=1e-7)


def test_constant_values_histogram(spark):
    values = spark.createDataFrame([(4, 7)], "value int, n long")
    rows = q.histogram(values, 4).orderBy("bin").collect()
    assert [(r.low, r.n) for r in rows] == [(3.5, 0), (3.75, 0), (4.0, 7), (4.25, 0)]
