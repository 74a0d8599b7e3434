"""Pairs of long lists, pairs with support, and sketches of distinct labels."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from labelweave.operators import cooccurrence as co
from labelweave.operators import labels as lab
from labelweave.operators import routing

LISTS = [["a", "b", "c", "d", "e"], ["a", "b"], ["a", "b"], ["c"], [], ["b", "d", "e", "f", "g", "h", "i"]]


def plain(lists, least=1):
    counts = Counter(p for one in lists for p in combinations(sorted(one), 2))
    return {p: n for p, n in counts.items() if n >= least}


def rows(pairs):
    return {(r["a"], r["b"]): r["n"] for r in pairs.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, one) for i, one in enumerate(LISTS + [None])], "doc_id long, labels array<string>")


@pytest.mark.parametrize("block", [1, 2, 3, 7, 256])
def test_pairs_by_blocks(docs, block):
    assert rows(co.pair_counts(lab.label_sets(docs), block)) == plain(LISTS)


def test_long_list_is_paired_by_many_tasks(spark):
    names = [f"l{i:05d}" for i in range(600)]
    sets = spark.createDataFrame([(names, 2)], "labels array<string>, n_docs long")
    cells = co._cells(sets, 50)
    assert cells.count() == 12 * 13 // 2
    assert cells.select(F.spark_partition_id().alias("t")).distinct().count() > 1
    pairs = co.pair_counts(sets, 50)
    assert pairs.agg(F.count(F.lit(1)), F.sum("n"), F.count_if(F.col("a") < F.col("b"))).first()[:] == (179700, 359400, 179700)


def test_frequent_pairs(spark, docs):
    for least in (1, 2, 3, 9):
        assert rows(co.frequent_pairs(lab.label_sets(docs), least, 2)) == plain(LISTS, least)
    assert rows(co.frequent_pairs(lab.label_sets(docs.limit(0)), 1)) == {}


def test_longest_lists_below_the_support_form_no_pairs(spark, monkeypatch):
    rng = random.Random(7)
    names = [f"l{i:03d}" for i in range(300)]
    lists = [names, names, names[40:], names[::3]]
    lists += [sorted(rng.sample(names, rng.randint(0, 6))) for _ in range(500)]
    frame = spark.createDataFrame(list(enumerate(lists)), "doc_id long, labels array<string>")
    counted, formed = co.pair_counts, []

    def seen(sets, block=co.BLOCK):
        formed.append(sets.agg(F.max(F.size("labels"))).first()[0])
        return counted(sets, block)

    monkeypatch.setattr(co, "pair_counts", seen)
    for least, longest in ((2, 300), (3, 260), (4, 100), (5, 6)):
        assert rows(co.frequent_pairs(lab.label_sets(frame), least, 8)) == plain(lists, least)
        assert formed[-1] == longest


@pytest.mark.parametrize("groups", [2, 64])
def test_long_lists_of_rows_come_in_pieces(spark, monkeypatch, groups):
    """No row holds a long list; one document has no id, rows repeat and some have no label."""
    rng = random.Random(11)
    names = [f"l{i:03d}" for i in range(120)]
    lists = {-1: names, None: names[30:], 1: names[::2], 2: names[::2], 3: []}
    lists |= {i: sorted(rng.sample(names, rng.randint(1, 5))) for i in range(4, 300)}
    rows_ = [(d, l) for d, one in lists.items() for l in one + one[:1]] + [(3, None), (4, None), (-1, None)]
    rng.shuffle(rows_)
    frame = spark.createDataFrame(rows_, "doc_id long, label string").repartition(5)
    monkeypatch.setattr(lab, "LONGEST", 16)
    monkeypatch.setattr(co, "GROUPS", groups)
    sets = lab.label_sets(frame)
    assert sets.agg(F.max(F.size("labels"))).first()[0] < 60
    assert sets.where("list is not null").agg(F.countDistinct("list")).first()[0] == 4
    assert sets.where("list is null").agg(F.sum("n_docs")).first()[0] == 297
    assert rows(co.pair_counts(sets)) == plain(lists.values())
    for least in (1, 2, 3, 5, 9):
        assert rows(co.frequent_pairs(sets, least, 8)) == plain(lists.values(), least)


def test_lists_without_rare_labels_fold(spark, docs):
    keep = spark.createDataFrame([("a",), ("b",)], "label string")
    left = {tuple(r["labels"]): r["n_docs"] for r in co.supported(lab.label_sets(docs), keep).collect()}
    assert left == {("a", "b"): 3, ("b",): 1}


def test_strong_conditionals_equal_all_conditionals(spark, docs):
    sets = lab.label_sets(docs)
    every = co.directed_conditionals(co.pair_counts(sets), co.set_label_counts(sets))
    for count, p in ((1, 0.0), (2, 0.5), (3, 0.6), (2, 0.99)):
        assert co.strong_conditionals(sets, count, p).collect() == co.high_conditionals(every, count, p).collect()


def test_sketches_add_up(spark):
    low = spark.range(0, 30000).select(F.lit(1).alias("part"), F.array(F.col("id").cast("string")).alias("labels"))
    high = spark.range(20000, 50000).select(F.lit(2).alias("part"), F.array(F.col("id").cast("string")).alias("labels"))
    none = spark.createDataFrame([(3, None), (3, [])], "part int, labels array<string>")
    both = lab.label_sketches(low).unionByName(lab.label_sketches(high)).unionByName(lab.label_sketches(none))
    assert abs(lab.sketched_labels(both).first()[0] - 50000) <= lab.sketch_error() * 50000
    assert lab.sketched_labels(both.where("part = 3")).first()[0] == 0
    assert lab.sketched_labels(both.limit(0)).first()[0] == 0


def test_scores_meet_names_by_position(spark):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(11)] + [(None, None)], "doc_id long, text string").repartition(2)
    names = [f"c{i}" for i in range(400)]

    def load():
        return lambda some: [[(len(t or "") + k) / 1000 for k in range(400)] for t in some]

    scored = routing.score_batches(texts, load, names, 4)
    assert "c399" not in scored._jdf.queryExecution().toString()
    for r in scored.collect():
        size = r["doc_id"] or 0
        assert [(c["label"], c["p"]) for c in r["cells"]] == [(n, (size + k) / 1000) for k, n in enumerate(names)]


def test_prefixes_by_sorted_scan(spark):
    rng = random.Random(5)
    names = {"".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randint(0, 9))) for _ in range(400)} | {"", "a" * 40}
    counts = [(name, i) for i, name in enumerate(sorted(names))]
    frame = spark.createDataFrame([*counts, (None, 1)], "label string, n long")
    for parts, extra in ((1, 4), (7, 4), (40, 1)):
        want = {(s, l, a, b) for s, a in counts for l, b in counts if l.startswith(s) and len(l) - len(s) >= extra}
        got = [tuple(r) for r in co.prefix_pairs(frame, extra, parts).collect()]
        assert len(got) == len(want) and set(got) == want
    assert co.prefix_pairs(frame.limit(0)).collect() == []


def test_a_chain_of_names_over_many_parts(spark):
    chain = spark.range(1, 121).select(F.expr("repeat('x', cast(id as int))").alias("label"), F.col("id").alias("n"))
    found = co.prefix_pairs(chain, 4, 12)
    assert found.count() == sum(max(0, n - 4) for n in range(1, 121))
    assert found.where("length(short) <> n_short or length(long) <> n_long").isEmpty()


def test_names_meet_those_of_earlier_runs(spark, monkeypatch):
    """Runs of two names, some of them repeated, which fall into different runs."""
    rng = random.Random(7)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(150)]
    counts = [(name, i) for i, name in enumerate(names)]
    frame = spark.createDataFrame(counts, "label string, n long")
    want = sorted((s, l, a, b) for s, a in counts for l, b in counts if l.startswith(s) and len(l) - len(s) >= 1)
    monkeypatch.setattr(co, "RUN", 2)
    found = co.prefix_pairs(frame, 1, 3)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
