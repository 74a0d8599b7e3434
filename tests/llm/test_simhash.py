"""SimHash groups against all pairs of fingerprints."""

import random
import re

import xxhash

import __spark_entry__ as entry
from labelweave.llm import simhash
from labelweave.llm.graph import connected_components
from plain import roots


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(prints):
    """doc_id to smallest doc_id over links of at most two bits, by brute force."""
    ids = sorted(prints)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    return roots(ids, edges)


def test_query(spark, small, texts):
    rows = entry.queries()["op6_simhash"](spark, small).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = grouped(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert any(i != c for i, c in want.items())


def test_odd_rows(spark, odd):
    rows = simhash.groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {by_id[i]["fp"] for i in (1, 2, 3)} == {0} and {by_id[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by_id[6]["component_id"] == 5
    assert by_id[7]["fp"] % 2**64 == plain_fingerprint("ein sehr langer Text " * 20_000)
    assert sorted(r["component_id"] or -1 for r in rows if r["doc_id"] is None) == [-1, 1]
    assert simhash.groups(odd.limit(0)).collect() == []


def test_links_are_those_of_all_pairs_with_and_without_hot_buckets(spark):
    pick = random.Random(5)
    prints = {pick.getrandbits(64) for _ in range(300)}
    base = pick.getrandbits(64)
    for _ in range(300):  # a dense cluster: many share a segment
        prints.add(base ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 4))))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    for hot in (4096, 8):
        got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, hot_bucket=hot).collect()}
        assert got == want


def test_components_of_paths_stars_and_loops(spark):
    pick = random.Random(7)
    path = [(i, i + 1) for i in range(100, 180)]
    pick.shuffle(path)
    edges = path + [(1000, i) for i in range(2000, 2400)] + [(5, 5), (9, 8), (8, 9), (-3, 9)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
