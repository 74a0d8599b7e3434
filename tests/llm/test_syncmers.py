"""Closed syncmers against a plain reading of their definition."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelweave.llm import syncmers


def hashed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def plain(text, k=5, s=1):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    if not words:
        return []
    found = []
    for i in range(len(words) - k + 1):
        inner = [hashed(" ".join(words[i + j : i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, hashed(" ".join(words[i : i + k]))))
    return found or [(0, hashed(" ".join(words)))]


def printed(marks):
    return ",".join(f"{(h % 2**64) >> 32:x}" for h in dict.fromkeys(h for _, h in marks))


def likeness(a, b):
    a, b = ({h for _, h in x} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """Rows in the order that the edit follows: (doc_id, text)."""
    out = []
    for n, (doc_id, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = plain(text), plain(edited), plain(following)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), likeness(a, b), likeness(a, c)))
    return out


def test_query(spark, small, texts):
    df = entry.queries()["op2_syncmers"](spark, small)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    want = expected([(i, texts[i]) for i in sorted(texts, reverse=True)])
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sum(w[5] for w in want) / len(want) > 0.25 > 0.05 > sum(w[6] for w in want) / len(want)


def test_many_buckets_and_odd_rows(spark, odd, monkeypatch):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(expected(rows), key=repr)
    for size in (2000, 2, 1):
        monkeypatch.setattr(syncmers, "ROWS_PER_BUCKET", size)
        assert sorted(map(tuple, syncmers.compare_with_edit(odd).collect()), key=repr) == want
    assert syncmers.compare_with_edit(odd.limit(0)).collect() == []
    one = syncmers.compare_with_edit(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_longer_inner_runs_and_context(spark, texts):
    long = [t for t in texts.values() if len(t) > 2000][:20]
    df = spark.createDataFrame([(t,) for t in long], "text string")
    got = [[tuple(a) for a in r["m"]] for r in df.select(syncmers.syncmers(F.col("text"), 8, 3).alias("m")).collect()]
    assert got == [plain(t, 8, 3) for t in long]
    alone, inside = set(h for _, h in plain(long[0])), set(h for _, h in plain("a b c " + long[0] + " d e f"))
    assert alone <= inside
