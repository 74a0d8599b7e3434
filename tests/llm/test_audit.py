"""Decision diagrams against plain counting of masks, and the table against SQL."""

import itertools
import random
import re

from labelweave.llm import audit
from labelweave.llm.queries import LLM_ORACLES, op12_filter_audit

import check


def test_every_order_comes_once_and_counts_rightly():
    pick = random.Random(1)
    for n in range(1, 6):
        for _ in range(5):
            counts = {m: (pick.randrange(4), pick.randrange(2), pick.randrange(2)) for m in range(1 << n) if pick.random() < 0.7}
            counts = counts or {0: (1, 0, 0)}
            found = list(audit.every_order(counts, n))
            assert [o for o, _ in found] != [] and sorted(o for o, _ in found) == sorted(itertools.permutations(range(n)))
            for order, path in found:
                before = 0
                for f, (got, removed, kept) in zip(order, path):
                    assert got == f
                    rows = [(m, c) for m, c in counts.items() if not m & before]
                    assert removed == tuple(sum(c[i] for m, c in rows if m >> f & 1) for i in range(3))
                    assert kept == tuple(sum(c[i] for m, c in rows if not m >> f & 1) for i in range(3))
                    before |= 1 << f


def test_a_swap_keeps_other_levels_and_equal_nodes_are_one():
    diagram = audit.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(level) for level in diagram.levels] == [1] * 5
    diagram = audit.Diagram({m: (m + 1,) for m in range(32)}, 5)
    before = [dict(level) for level in diagram.levels]
    diagram.swap(2)
    assert diagram.order == [0, 1, 3, 2, 4]
    assert [diagram.levels[k] for k in (0, 1, 4)] == [before[k] for k in (0, 1, 4)]
    diagram.swap(2)
    assert diagram.order == [0, 1, 2, 3, 4] and sorted(diagram.sums[n] for n in diagram.levels[3].values()) == [(52 + 4 * k,) for k in range(8)]


def plain(rows, labels):
    """Every row of the result, counted document by document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy,
        }
        docs.append((lang or "", fails, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                failing = [d for d in own if d[1][f]]
                alone = sum(all(bad == (g == f) for g, bad in d[1].items()) for d in own)
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(kept), len(gone), len(failing) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone), f))
                left = kept
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    rows += [(20, "SAME " * 120, None), (21, "SAME " * 120, "en"), (22, "SAME " * 120, "fr"), (20, "SAME " * 120, None), (23, "a | b", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, mask int")
    marks = [(1, 1, 0), (5, 1, 1), (5, 0, 0), (21, None, 1), (None, 1, 1), (99, 1, 1), (22, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit(docs, labels).collect())
    assert got == plain(rows, marks)
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert {r["good_lost"] for r in audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_against_sql(spark, small, con):
    assert check.compare(op12_filter_audit(spark, small), con, LLM_ORACLES["op12_filter_audit"]) is None
