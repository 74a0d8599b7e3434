"""Periodic runs against a scan of every period."""

import hashlib
import re
import zlib

import numpy as np

from labelweave.llm import runs
from labelweave.llm.queries import LLM_ORACLES, op13_periodic_runs

import check


def plain_runs(words, least=12):
    """(start, length, period) of all runs, by every period and position."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(i + 1, j + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_cover_is_a_difference_cover():
    assert {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))


def test_extensions_against_plain_comparison():
    pick = np.random.default_rng(2)
    for trial in range(20):
        n = int(pick.integers(2, 400))
        words = pick.integers(0, 2 if trial % 2 else 9, n)
        if trial % 3 == 0:
            words = np.resize(words[: max(1, n // 5)], n)
        closed = np.append(words, 99)
        i, j = pick.integers(0, n, (2, 300))
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(n + 1) if closed[a + k] != closed[b + k]) for a, b in zip(i, j)]
        assert runs.Extensions(closed).longest(i, j).tolist() == want


def test_runs_of_random_and_periodic_texts():
    pick = np.random.default_rng(3)
    for _ in range(150):
        texts = []
        for _ in range(int(pick.integers(1, 6))):
            n = int(pick.integers(0, 150))
            words = pick.integers(0, int(pick.integers(1, 6)), n)
            if n > 20 and pick.random() < 0.6:
                start, p = int(pick.integers(0, n)), int(pick.integers(1, 40))
                words = np.array([words[i] if i < start else words[start + (i - start) % p] for i in range(n)])
            texts.append(words)
        got = [[tuple(r) for r in found.tolist()] for found in runs.find_runs(texts)]
        assert got == [plain_runs(t.tolist()) for t in texts]


def test_long_texts():
    pick = np.random.default_rng(4)
    words = pick.integers(0, 5000, 30_000)
    words[10_000:] = np.resize(words[10_000:15_000], 20_000)
    found = runs.find_runs([words, np.zeros(40_000, dtype=np.int64), pick.integers(0, 5000, 50)])
    assert [tuple(r) for r in found[0].tolist() if r[1] > 100] == [(10_000, 20_000, 5000)]
    assert found[1].tolist() == [[0, 40_000, 1]] and found[2].tolist() == []


def edited(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = edited(doc_id, text)
    found = plain_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def written(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_odd_rows(spark, odd, tmp_path):
    got = [tuple(r) for r in op13_periodic_runs(spark, written(spark, tmp_path / "a", odd)).collect()]
    # The long text of four words over and over is one run; the plain scan of all its periods would not end.
    want = [expected(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 7]
    assert sorted((r for r in got if r[0] != 7), key=repr) == sorted(want, key=repr)
    long = next(r for r in got if r[0] == 7)
    assert long[1:6] == (1, 0, 80_000, 4, 20_000_000) and long[7] == hashlib.sha256(b"ein sehr langer Text").hexdigest()
    assert op13_periodic_runs(spark, written(spark, tmp_path / "b", odd.limit(0))).collect() == []


def test_changed_texts(spark, tmp_path):
    pick = np.random.default_rng(5)
    rows = [(i, " \t".join(f"w{x}" for x in pick.integers(0, 40, int(pick.integers(0, 120))))) for i in range(200)]
    got = op13_periodic_runs(spark, written(spark, tmp_path / "c", spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(tuple(r) for r in got) == [expected(*r) for r in rows]
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_against_sql(spark, small, con):
    assert check.compare(op13_periodic_runs(spark, small), con, LLM_ORACLES["op13_periodic_runs"]) is None
