"""Near copies against all pairs of exact shingle sets."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from labelweave.llm import nearcopies
from plain import roots


def plain_shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def written(pick, n):
    return [f"w{pick.randrange(5000)}" for _ in range(n)]


def edited(pick, words, n):
    out = list(words)
    for i in pick.sample(range(len(out)), n):
        out[i] = f"e{pick.randrange(10**6)}"
    return out


def test_stage_drops_near_copies_that_simhash_alone_misses(spark, small):
    pick = random.Random(3)
    texts = {}
    for i in range(0, 200, 4):
        base = written(pick, pick.choice((60, 200, 900)))
        few, many = len(base) // 90 + 1, len(base) // 8
        # The last shares words, not shingles enough.
        for j, words in enumerate((base, edited(pick, base, few), edited(pick, base, few), edited(pick, base, many))):
            texts[i + j] = " ".join(words)
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    groups = roots(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, small)
    assert {r["doc_id"] for r in out.collect()} == set(groups.values())
    assert 50 <= len(set(groups.values())) < 150


def all_groups(sets):
    """Groups by every pair of sets that shares a shingle."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for own in holders.values() for n, a in enumerate(own) for b in own[:n]}
    return roots(range(len(sets)), [(a, b) for a, b in pairs if alike(sets[a], sets[b])])


def test_crowded_shingles_lose_no_group(spark):
    """A thousand texts that share a passage: few are near copies, and many of those not of the first one."""
    pick = random.Random(4)
    passage = written(pick, 60)
    texts = []
    for _ in range(60):
        own = written(pick, pick.choice((6, 10, 14, 300)))
        for _ in range(pick.choice((1, 2, 8, 40))):
            at = pick.randrange(len(own))
            texts.append(" ".join(edited(pick, own[:at] + passage + own[at:], pick.choice((0, 0, 1, 2)))))
    texts = (texts * 3)[:1000] + [" ".join(edited(pick, passage, 1)) for _ in range(40)]
    sets = [plain_shingles(t) for t in texts]
    want = all_groups(sets)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs).collect()}
    assert got == want and 20 < len(set(want.values())) < 900


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = all_groups([plain_shingles(r["text"] or "") for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs).collect()}
    assert got == {rows[i]["doc_id"]: rows[root]["doc_id"] for i, root in want.items()}


def test_bounds_hold_for_every_pair_of_near_copies():
    pick = random.Random(6)
    for _ in range(400):
        n = pick.randrange(1, 200)
        a = set(pick.sample(range(10**6), n))
        b = set(a)
        for _ in range(pick.randrange(0, n // 5 + 2)):
            if pick.random() < 0.5 and len(b) > 1:
                b.remove(pick.choice(sorted(b)))
            else:
                b.add(pick.randrange(10**6, 2 * 10**6))
        x, y = (np.array(sorted(v * 0x9E3779B97F4A7C15 % 2**64 for v in s), dtype="<u8") for s in (a, b))
        same = nearcopies.possible([nearcopies.sketch(x)], [nearcopies.sketch(y)], np.array([len(x)]), np.array([len(y)]))[0]
        if 5 * len(a & b) >= 4 * len(a | b):
            (looked_x, need_x), (looked_y, need_y) = nearcopies.first_shingles(len(x)), nearcopies.first_shingles(len(y))
            assert same and len(set(x[:looked_x].tolist()) & set(y[:looked_y].tolist())) >= max(need_x, need_y)
    far = [np.array(sorted(pick.sample(range(2**60), 300)), dtype="<u8") for _ in range(2)]
    assert not nearcopies.possible(*[[nearcopies.sketch(x)] for x in far], np.array([300]), np.array([300]))[0]


def test_texts_without_blanks_are_one_word(spark):
    docs = spark.createDataFrame([(1, "漢字" * 500), (2, "漢字" * 500), (3, "漢字" * 499), (4, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rows_of_one_doc_id_are_told_apart(spark):
    a, b = "one text of a few more words than five", "quite another text that shares nothing with it at all"
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "z"), (2, a, "x"), (None, b, "x"), (None, "a text without an id that is alone", "x"), (3, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_key string")
    kept = [tuple(r) for r in nearcopies.first_of_groups(docs).collect()]
    assert sorted((r[:2] for r in kept), key=repr) == sorted([(1, a), (1, b), (None, rows[5][1]), (3, None)], key=repr)


def test_odd_rows(spark, odd):
    rows = nearcopies.groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[6] == 5 and by_id[4] == 4
    assert sorted(r["component_id"] or -1 for r in rows if r["doc_id"] is None) == [-1, 1]
    assert nearcopies.groups(odd.limit(0)).collect() == []
    kept = nearcopies.first_of_groups(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5, 7, 8, 9, 10]
    assert nearcopies.first_of_groups(odd.limit(0)).collect() == []


def test_pairs_that_are_dropped_are_never_rows(spark, monkeypatch):
    """A cloud of texts that share most shingles while few pairs are near copies: blocks pass on few rows, and no group is lost."""
    pick = random.Random(9)
    base = written(pick, 200)
    texts = [" ".join(edited(pick, base, pick.choice((2, 3, 7, 8, 9)))) for _ in range(400)]
    sets = [plain_shingles(t) for t in texts]
    passed = []
    across = nearcopies._across
    monkeypatch.setattr(nearcopies, "_across", lambda *a, **b: passed.append(across(*a, **b)) or passed[-1])
    monkeypatch.setattr(nearcopies, "BLOCK", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(docs).collect()}
    want = all_groups(sets)
    pairs = sum(1 for a in range(400) for b in range(a) if want[a] != want[b])
    assert got == want and 20 < len(set(want.values()))
    assert sum(p.count() for p in passed) < pairs / 4
