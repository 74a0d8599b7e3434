"""Top-k search against all products."""

import math

import numpy as np

from labelweave.llm import topk
from labelweave.llm.queries import LLM_ORACLES, op11_top_k

import check


def plain(vectors, query, k, own):
    scores = [(-sum(int(a) * int(b) for a, b in zip(v, query)), i) for i, v in enumerate(vectors) if i != own]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_search_against_all_products():
    pick = np.random.default_rng(1)
    # The last scales leave the exact range of doubles.
    for dim, n, scale in ((64, 1500, 200), (4, 300, 200), (1, 200, 5), (3, 60, 1e12), (2, 40, 1e200), (0, 20, 1), (8, 5, 9)):
        vectors = np.floor(pick.normal(size=(n, dim)) * scale)
        vectors[n // 2 : n // 2 + n // 4] = vectors[0]
        lists = topk.Lists.of(vectors)
        for own in (None, 0, n // 2, n - 1):
            for query in (vectors[own or 0], np.floor(pick.normal(size=dim) * scale), np.zeros(dim)):
                found = topk.search(lists, query, 10, own)
                assert [(int(i), int(s)) for i, s in zip(found.rows, found.scores)] == plain(vectors, query, 10, own)
        assert np.array_equal(topk.Lists.read(lists.ranked, lists.sorted).vectors, vectors)


def test_reading_stops_early():
    pick = np.random.default_rng(2)
    vectors = np.floor(pick.normal(size=(4000, 3)) * 200)
    depths = [topk.search(topk.Lists.of(vectors), v, 10).depth for v in vectors[:20]]
    assert max(depths) < 4000


def test_table_in_small_blocks(spark):
    pick = np.random.default_rng(3)
    rows = [(i, [float(x) for x in pick.normal(size=6)]) for i in range(400)] + [(i, [0.5, -0.25]) for i in range(1000, 1040)]
    rows += [(200, [1.0] * 6), (None, [2.0] * 6), (None, None), (500, None), (600, [math.nan] * 6), (700, [None] * 6), (800, [math.inf] * 6), (900, [])]
    docs = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, rank string")
    got = topk.top_k(docs.repartition(3), k=5, every=20, cells=60).collect()
    usable = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for n, (i, e) in enumerate(usable):
        if i is not None and i % 20 == 0:
            others = [(-sum(a * b for a, b in zip(e, f)), j is None, j or 0) for m, (j, f) in enumerate(usable) if m != n and len(e) == len(f)]
            want += [(i, r, None if gone else j, -s) for r, (s, gone, j) in enumerate(sorted(others)[:5], 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert topk.top_k(docs.limit(0)).collect() == []


def test_against_sql(spark, small, con):
    assert check.compare(op11_top_k(spark, small), con, LLM_ORACLES["op11_top_k"]) is None
