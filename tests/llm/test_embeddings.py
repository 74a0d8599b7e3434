"""Embedding groups against all pairs."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
import check
from labelweave.llm import embeddings
from plain import roots


def plain(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, dtype=np.float64), label)
    edges = []
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, la), (y, lb) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                edges.append((a, b))
    links = {i: 0 for i, *_ in rows}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    found = roots([i for i, *_ in rows], edges)
    return {i: (links[i], found[i], found[i] == i) for i in links}


def test_query_against_sql(spark, small, con):
    df = entry.queries()["op3_embeddings"](spark, small)
    assert check.compare(df, con, entry.oracle_sql()["op3_embeddings"]) is None


@pytest.mark.parametrize("tile", [3, 64])
def test_clusters_copies_and_bad_vectors(spark, tile):
    pick = random.Random(3)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            centre = [pick.gauss(0, 1) for _ in range(20)]
            for _ in range(8):
                rows.append((n, [c + pick.gauss(0, 0.3) for c in centre], label))
                n += 1
    rows += [(n + k, rows[k % 3][1], 0) for k in range(30)]
    rows += [(900, [0.0] * 20, 0), (901, None, 0), (902, [float("nan")] * 20, 0), (903, [1.0, None] + [0.0] * 18, 0),
             (904, [], 0), (905, [float("inf")] + [0.0] * 19, 0), (906, rows[0][1][:10], 0), (907, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, 0.93, tile).collect()}
    assert got == plain(rows, 0.93)


def test_null_ids_repeats_and_no_rows(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 1), (4, v, 1), (4, v, 1), (2, v, 1), (3, v, 2)], "vec_id long, embedding array<float>, label int")
    rows = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr)
    assert rows == sorted([(None, 0, None, False), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (3, 0, 3, True)], key=repr)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []
