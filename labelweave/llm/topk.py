"""Exact top-k search by inner product, aggregating sorted lists without random access.

A block of vectors is a sorted list per dimension. A query reads all lists
in step, each from the end where its products are largest. What it has read
of a vector, with the products still possible in the lists where it has not
met that vector, bounds the vector's score from both sides. Reading stops as
soon as vectors never met can't come among the k best and few of the others
can; only the final scores of those are then worked out in full. The k best
of every block are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.worker import slices
from labelweave.plans.durable import stored

CELLS = 1 << 21
QUERIES_TOGETHER = 256
EXACT = 1 << 53  # doubles hold every integer up to this
LONGEST = (1 << 63) - 1
VECTORS = "vec_id bigint, dim int, vec binary"
BLOCKS = "dim int, rows binary, ids binary, named binary, ranked binary, sorted binary"
FOUND = "query_row bigint, query_id bigint, vec_row bigint, vec_id bigint, score bigint"


def integers(values: pa.Array | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) of each component in double precision; None when it can't be compared."""
    if values is None or values.null_count:
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.floor(scale * values.to_numpy(zero_copy_only=False).astype("<f8"))
    return out if np.isfinite(out).all() else None


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where they fit, else as doubles; a sign tells which."""
    small = np.abs(x).max(initial=0) < 1 << 15
    return b"s" + x.astype("<i2").tobytes() if small else b"d" + x.astype("<f8").tobytes()


def _wide(raw: memoryview) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i2" if bytes(raw[:1]) == b"s" else "<f8", offset=1).astype(np.float64)


@dataclass
class Lists:
    """A block: row i of all vectors, in order of their ids; list d holds rows by falling component d."""

    vectors: np.ndarray
    ranked: np.ndarray
    sorted: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Lists:
        ranked = np.argsort(-vectors, axis=0, kind="stable").T.copy()
        return cls(vectors, ranked, np.take_along_axis(vectors.T, ranked, axis=1))

    @classmethod
    def read(cls, ranked: np.ndarray, values: np.ndarray) -> Lists:
        vectors = np.empty(ranked.shape[::-1])
        vectors[ranked, np.arange(len(ranked))[:, None]] = values
        return cls(vectors, ranked, values)


@dataclass
class Search:
    """The rows that a search found, their scores, and how much of each list it read."""

    rows: np.ndarray
    scores: np.ndarray
    depth: int


def search(lists: Lists, query: np.ndarray, k: int, own: int | None = None) -> Search:
    """The ``k`` rows with the largest products with ``query``, ties by row; row ``own`` takes no part.

    Works on doubles while they hold every sum exactly, on Python's integers
    beyond that.
    """
    n, dim = lists.vectors.shape
    most = int(np.abs(lists.vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(1, dim)
    kind = np.float64 if most < EXACT else object

    def exact(x: np.ndarray) -> np.ndarray:
        return x if kind is np.float64 else np.array([int(v) for v in x.reshape(-1)] or [], dtype=object).reshape(x.shape)

    def resolved(rows: np.ndarray, depth: int) -> Search:
        scores = exact(lists.vectors[rows]) @ exact(query) if dim else exact(np.zeros(len(rows)))
        if len(rows) > k:
            among = scores >= np.sort(scores)[-k]
            rows, scores = rows[among], scores[among]
        best = np.lexsort((rows, -scores))[:k]
        return Search(rows[best], scores[best], depth)

    used = np.flatnonzero(query)
    rest = n - (own is not None)
    if rest <= k or not len(used):
        rows = np.arange(n)
        return resolved(rows[rows != own] if own is not None else rows, 0)
    # Lists with a negative weight are read from their other end.
    used = np.concatenate([used[query[used] > 0], used[query[used] < 0]])
    falling = int((query > 0).sum())
    weights = exact(query[used])
    least = weights * exact(np.concatenate([lists.sorted[used[:falling], -1], lists.sorted[used[falling:], 0]]))
    known = np.zeros(n, dtype=kind)
    seen = np.zeros((len(used), n), dtype=bool)
    depth, few = 0, 4 * k
    never = -np.inf if kind is np.float64 else -(int(most) + 1) * 4

    def step(table: np.ndarray, start: int, end: int) -> np.ndarray:
        return np.concatenate([table[used[:falling], start:end], table[used[falling:], n - end : n - start][:, ::-1]])

    while depth < n:
        start, depth = depth, min(n, depth + max(k, n // 8))
        met = step(lists.ranked, start, depth)
        products = weights[:, None] * exact(step(lists.sorted, start, depth))
        if kind is np.float64:
            known += np.bincount(met.reshape(-1), weights=products.reshape(-1), minlength=n)
        else:
            np.add.at(known, met, products)
        for row, read in zip(seen, met):
            row[read] = True
        if own is not None:
            known[own] = never
        most_left = products[:, -1]
        # The k-th best lower bound of any rows is one of all rows.
        leading = np.argsort(known)[-few:] if kind is object else np.argpartition(known, -few)[-few:] if few < n else np.arange(n)
        lower = known[leading] + least @ (~seen[:, leading]).astype(kind)
        qualifying = np.sort(lower)[-k]
        if qualifying > most_left.sum():
            break
    able = np.flatnonzero(known + np.maximum(most_left, 0).sum() >= qualifying)
    able = able[known[able] + most_left @ (~seen[:, able]).astype(kind) >= qualifying]
    return resolved(able, depth)


def _marked(vectors: DataFrame, scale: float) -> DataFrame:
    """(row, vec_id, dim, vec) of every vector that can be compared; row numbers are fixed once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            found = [integers(column[i].values, scale) for i in range(batch.num_rows)]
            usable = pa.array([v is not None for v in found])
            kept = [v for v in found if v is not None]
            yield pa.record_batch(
                [batch.column("vec_id").filter(usable), pa.array([len(v) for v in kept], pa.int32()), pa.array([_narrow(v) for v in kept], pa.binary())],
                names=["vec_id", "dim", "vec"],
            )

    read = vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, VECTORS)
    return stored(read.withColumn("row", F.monotonically_increasing_id()), "integer-vectors")


def _gathered(marked: DataFrame, most: int, with_lists: bool) -> DataFrame:
    """Rows of one dimension count together, as blocks of at most ``most`` components or ``most`` rows."""

    def block(dim: int, held: list[tuple]) -> tuple:
        held.sort(key=lambda h: (h[1] is None, h[1] or 0, h[0]))
        vectors = np.array([_wide(memoryview(h[2])) for h in held]).reshape(len(held), dim)
        lists = Lists.of(vectors) if with_lists else None
        return (
            dim, np.array([h[0] for h in held], dtype="<i8").tobytes(), np.array([h[1] or 0 for h in held], dtype="<i8").tobytes(),
            np.array([h[1] is not None for h in held]).tobytes(),
            lists.ranked.astype("<u4").tobytes() if lists else None, _narrow(lists.sorted if lists else vectors),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        kinds = (pa.int32(), *[pa.binary()] * 5)
        names = [f.split()[0] for f in BLOCKS.split(", ")]

        def close(dim: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x], k) for x, k in zip(block(dim, held.pop(dim)), kinds)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "row", "vec_id", "vec"))):
                held.setdefault(row[0], []).append(row[1:])
                if len(held[row[0]]) * (max(1, row[0]) if with_lists else 1) >= most:
                    yield close(row[0])
                elif sum(map(len, held.values())) > most:
                    yield close(max(held, key=lambda d: len(held[d])))
        for dim in list(held):
            yield close(dim)

    return marked.mapInArrow(run, BLOCKS)


def top_k(vectors: DataFrame, k: int = 10, scale: float = 1024.0, every: int = 100, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each query row of ``vectors`` (vec_id, embedding).

    Components become floor(scale * x). Queries are the rows whose vec_id is
    divisible by ``every``; candidates are all rows but the query's own. Each
    block of at most ``cells`` components meets every block of queries in the
    one task that holds its lists, so a task holds one block and a few blocks
    of queries, and what is shuffled are the lists and one copy of the
    queries for each block.

    Ties go to the smaller vec_id, a null one last. A vector that is null,
    holds null or non-finite components or leaves the doubles when scaled
    takes no part; vectors of different length are not compared; those
    without components score 0. Rows that share a vec_id are rows of their
    own, each a candidate of the others, and each ranked apart where they are
    queries. Scores beyond 64 bits are ranked as they are and given as the
    largest long. An empty table gives no rows; other columns are not read.
    """
    marked = _marked(vectors, scale)
    blocks = stored(_gathered(marked, cells, True).withColumn("block", F.monotonically_increasing_id()), "sorted-lists")
    asked = stored(_gathered(marked.where(F.col("vec_id") % every == 0), QUERIES_TOGETHER, False), "queries")
    # The window holds one narrow row per block.
    numbered = stored(blocks.select("block", "dim").withColumn("slot", F.row_number().over(Window.orderBy("dim", "block")) - 1), "block-slots")
    spans = numbered.groupBy("dim").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    copies = asked.join(spans, "dim").select("*", F.explode(F.sequence("first", "last")).alias("slot")).drop("first", "last")
    payload = [f.split()[0] for f in BLOCKS.split(", ")]
    both = (
        blocks.join(numbered.select("block", "slot"), "block").select("slot", F.lit(False).alias("asks"), *payload)
        .unionByName(copies.select("slot", F.lit(True).alias("asks"), *payload))
    )
    placed = both.repartitionById(max(1, numbered.count()), F.col("slot")).sortWithinPartitions("slot", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = rows = ids = named = None
        for batch in slices(batches, 1):
            dim, asks = batch.column("dim")[0].as_py(), batch.column("asks")[0].as_py()

            def part(name: str, kind: str) -> np.ndarray:
                return np.frombuffer(batch.column(name)[0].as_buffer(), dtype=kind)

            own_rows, own_ids, own_named = part("rows", "<i8"), part("ids", "<i8"), part("named", "?")
            values = _wide(memoryview(batch.column("sorted")[0].as_buffer()))
            if not asks:
                rows, ids, named = own_rows.copy(), own_ids.copy(), own_named.copy()
                ranked = part("ranked", "<u4").astype(np.int64)
                lists = Lists.read(ranked.reshape(dim, len(rows)), values.reshape(dim, len(rows)))
                place = {row: i for i, row in enumerate(rows.tolist())}
                continue
            out: list[tuple] = []
            for row, query_id, query in zip(own_rows.tolist(), own_ids.tolist(), values.reshape(len(own_rows), dim)):
                found = search(lists, query, k, place.get(row))
                for i, score in zip(found.rows.tolist(), found.scores):
                    kept = max(-LONGEST - 1, min(LONGEST, int(score)))
                    out.append((row, query_id, int(rows[i]), int(ids[i]) if named[i] else None, kept))
            kinds = [pa.int64()] * 5
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")
    ranked = placed.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
