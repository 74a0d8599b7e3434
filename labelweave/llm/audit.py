"""Filter interaction audit with decision diagrams.

Every document has a failure mask, one bit for each filter. The masks of a
part of the corpus, counted, are one decision diagram with a level for each
filter: a node stands for all documents that answer the filters above it in
one way, branches to those that pass its filter and those that fail it, and
knows the counts below it. Swapping two adjacent levels touches these two
levels only, so all orders of the filters are visited by such swaps, and the
path on which every filter is passed tells what each step removes and keeps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from string import ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.worker import slices
from labelweave.plans.durable import stored

# The five filters.
FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
UPPER = ascii_uppercase.encode()
SIGNS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")

Counts = tuple[int, ...]
STEPS = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels k whose swaps with k + 1, one after the other, visit every order of ``n`` levels once.

    The last level wanders through the others from end to end; between two
    such walks the others make one swap of their own.
    """
    if n < 2:
        return
    others, upwards = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if upwards else range(n - 1)
        swap = next(others, None)
        if swap is None:
            return
        yield swap + 1 if upwards else swap
        upwards = not upwards


class Diagram:
    """Counted failure masks as a decision diagram; equal nodes of a level are one.

    ``counts`` maps a mask to a tuple of numbers that add up; bit f of a mask
    is set where filter f fails.
    """

    def __init__(self, counts: dict[int, Counts], filters: int):
        self.order = list(range(filters))
        self.nothing = (0,) * len(next(iter(counts.values())))
        self.sums: list[Counts] = []
        self.children: dict[int, tuple[int, int]] = {}
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]
        ends: dict[Counts, int] = {}

        def build(level: int, mask: int) -> int:
            if level < filters:
                return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))
            held = counts.get(mask, self.nothing)
            if held not in ends:
                ends[held] = self._new(held)
            return ends[held]

        self.root = build(0, 0)

    def _new(self, sums: Counts) -> int:
        self.sums.append(sums)
        return len(self.sums) - 1

    def _node(self, level: int, passed: int, failed: int) -> int:
        table, key = self.levels[level], (passed, failed)
        if key not in table:
            table[key] = self._new(tuple(a + b for a, b in zip(self.sums[passed], self.sums[failed])))
            self.children[table[key]] = key
        return table[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below; nodes of other levels stay as they are."""
        below = self.levels[level + 1]
        self.levels[level + 1] = {}
        renewed = {}
        for (passed, failed), node in self.levels[level].items():
            (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
            renewed[self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)] = node
        for node in below.values():
            del self.children[node]
        self.levels[level] = renewed
        self.children.update({node: key for key, node in renewed.items()})
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> Iterator[tuple[int, Counts, Counts]]:
        """(filter, counts it removes, counts it keeps) for each level from the top."""
        node = self.root
        for f in self.order:
            node, failed = self.children[node]
            yield f, self.sums[failed], self.sums[node]


def every_order(counts: dict[int, Counts], filters: int) -> Iterator[tuple[tuple[int, ...], list[tuple[int, Counts, Counts]]]]:
    """(order, its all-pass path) for each order of the filters."""
    diagram = Diagram(counts, filters)
    yield tuple(diagram.order), list(diagram.all_pass_path())
    for level in adjacent_swaps(filters):
        diagram.swap(level)
        yield tuple(diagram.order), list(diagram.all_pass_path())


def steps(counted: DataFrame, filters: Sequence[str]) -> DataFrame:
    """A row for each part, order of ``filters`` and step, from counted masks.

    ``counted`` is (part, mask, n, good, toxic), one row for each mask of a
    part, so a group holds 2 ** len(filters) narrow rows at most. What a
    filter fails in all is what it removes as the first; what only it fails is
    what it removes as the last.
    """
    names, n_filters = list(filters), len(filters)

    def run(table: pa.Table) -> pa.Table:
        part, masks, *held = (table.column(c).to_pylist() for c in ("part", "mask", "n", "good", "toxic"))
        paths = list(every_order(dict(zip(masks, zip(*held))), n_filters))
        fails, alone, shares = {}, {}, [0] * n_filters
        for _, path in paths:
            fails[path[0][0]], alone[path[-1][0]] = path[0][1][0], path[-1][1][0]
            for f, removed, _ in path:
                shares[f] += removed[0]
        rows = [
            (part[0], "".join(names[f] for f in order), step, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], shares[f])
            for order, path in paths
            for step, (f, removed, kept) in enumerate(path, 1)
        ]
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        fields = [name.split()[0] for name in STEPS.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    return counted.groupBy("part").applyInArrow(run, STEPS)


def own_failures(text: str) -> int:
    """The mask of the filters that look at one text alone, A to D."""
    raw = text.encode()
    words = raw.split()
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(raw) - len(raw.translate(None, UPPER))) > UPPER_PERCENT * len(text),
        len(raw.translate(None, SIGNS)) < len(raw),
    )
    return sum(bit << f for f, bit in enumerate(failed))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each lang counted by the filters they fail.

    Texts travel no further than the task that reads them; copies are found
    by SHA-256. Rows are first counted by doc_id, so that a text that a third
    of the rows share is one row per task, lang and label from there on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(t.encode()).digest() for t in texts]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("part"), pa.array(map(own_failures, texts), pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "mask", "digest"],
            )

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    read = docs.select(F.col("doc_id").cast("bigint"), part, "text")
    marked = stored(read.mapInArrow(run, "doc_id bigint, part string, mask int, digest binary"), "audit-masks")
    flags = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    flagged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*flags)

    kind = ["part", "mask", "good", "toxic"]
    known = marked.where("doc_id is not null").join(flagged, "doc_id", "left").fillna(0, ["good", "toxic"])
    by_id = known.groupBy("doc_id", "digest", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = by_text.withColumn("smallest", smallest).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct("mask", originals.alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - originals).alias("n")),
        )).alias("m"),
    ).select("part", "m.mask", "m.n", "good", "toxic")
    nameless = marked.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    all_rows = split.unionByName(nameless.withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    return all_rows.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the five filters do to ``docs`` (doc_id, text, lang) in every order; see ``steps``.

    A null text is empty and a copy of every empty one; a null lang is the
    part ''. E fails where a smaller doc_id has the same text anywhere in the
    table: a null doc_id is not smaller than any and never fails, and rows
    that share a doc_id are not smaller than each other. Repeated rows count
    as often as they come. A document is good or toxic if any row of
    ``labels`` (doc_id, quality, toxic) says so; labels without doc_id or
    document don't count. An empty table gives no rows; other columns are not
    read.
    """
    return steps(failure_masks(docs, labels), FILTERS)
