"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are turned into a basis in which the leading dimensions hold most of
their length, sorted by the first one and cut into tiles. Two tiles are
compared only when their ranges of the first dimension are close enough. In a
pair of tiles the products of the leading dimensions are accumulated first;
what the other dimensions can still add is at most the product of the suffix
norms, so a pair stops as soon as its cosine cannot reach the threshold.
What is left is decided by the cosine of the original vectors in double
precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.graph import connected_components
from labelweave.plans.durable import stored

THRESHOLD = 0.93
TILE = 512
SLACK = 1e-9
PAIRS_AT_ONCE = 1 << 15
VECTORS = "vec_id bigint, label bigint, dim int, vec binary, lead double"
TILES = "label bigint, dim int, low double, high double, classes binary, copies binary, data binary"
FOUND = "class_id bigint, links bigint, root bigint"


def valid_vectors(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Each row's vector as doubles; None when it can't be compared."""
    out: list[np.ndarray | None] = []
    column = batch.column("embedding")
    for i in range(batch.num_rows):
        values = column[i].values
        if values is None or len(values) == 0 or values.null_count:
            out.append(None)
            continue
        v = values.to_numpy(zero_copy_only=False).astype("<f8")
        length = np.sqrt(v @ v)
        out.append(v if np.isfinite(v).all() and np.isfinite(length) and length > 0 else None)
    return out


def pca_bases(vectors: DataFrame, sample: int = 20_000) -> dict[int, np.ndarray]:
    """An orthonormal basis per dimension count, longest shares first.

    Fitted on about ``sample`` vectors chosen by a hash, a bound on what
    reaches the driver. Any basis gives the same links; this one stops early.
    """
    usable = vectors.where("label is not null and embedding is not null")
    n = usable.count()
    spread = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 20)) / float(1 << 20)
    rows = usable.where(spread < min(1.0, sample / max(n, 1))).select("embedding").toArrow()
    by_dim: dict[int, list[np.ndarray]] = {}
    for batch in rows.to_batches():
        for v in valid_vectors(batch):
            if v is not None:
                by_dim.setdefault(len(v), []).append(v / np.sqrt(v @ v))
    bases = {}
    for dim, unit in by_dim.items():
        stacked = np.array(unit)
        bases[dim] = np.linalg.eigh(stacked.T @ stacked)[1][:, ::-1].copy()
    return bases


def _marked(vectors: DataFrame, sent) -> DataFrame:
    """Every row with its vector as bytes and its leading coordinate, both null when it can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = sent.value
        for batch in batches:
            found = valid_vectors(batch)
            labels, ids = batch.column("label").to_pylist(), batch.column("vec_id").to_pylist()
            found = [None if l is None or i is None else v for v, l, i in zip(found, labels, ids)]
            lead = [None if v is None else float(v @ _first(bases, len(v)) / np.sqrt(v @ v)) for v in found]
            yield pa.record_batch(
                [
                    batch.column("vec_id"), batch.column("label"),
                    pa.array([None if v is None else len(v) for v in found], pa.int32()),
                    pa.array([None if v is None else v.tobytes() for v in found], pa.binary()), pa.array(lead, pa.float64()),
                ],
                names=["vec_id", "label", "dim", "vec", "lead"],
            )

    return stored(vectors.mapInArrow(run, VECTORS), "vectors")


def _basis(bases: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return bases[dim] if dim in bases else np.eye(dim)


def _first(bases: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return _basis(bases, dim)[:, 0]


def _tiles(classes: DataFrame, tile: int) -> DataFrame:
    """Classes in order of label, dimension count and leading coordinate, in tiles of at most ``tile``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            label, dim = held[0][:2]
            columns = [
                [label], [dim], [held[0][2]], [held[-1][2]],
                [np.array([h[3] for h in held], dtype="<i8").tobytes()], [np.array([h[4] for h in held], dtype="<i8").tobytes()],
                [b"".join(h[5] for h in held)],
            ]
            held.clear()
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            names = ["label", "dim", "low", "high", "classes", "copies", "data"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "lead", "class_id", "copies", "vec"))):
                if held and (len(held) == tile or held[-1][:2] != row[:2]):
                    yield close()
                held.append(row)
        if held:
            yield close()

    key = ["label", "dim", "lead", "class_id"]
    ordered = classes.repartitionByRange(*key).sortWithinPartitions(*key)
    return stored(ordered.mapInArrow(run, TILES).withColumn("tile", F.monotonically_increasing_id()), "tiles")


def _close_tiles(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles (tile, other) whose leading coordinates come close enough, each once and with itself.

    Unit vectors of cosine t are sqrt(2 - 2t) apart at most, and so are their
    leading coordinates. The windows hold one narrow row per tile.
    """
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    place = ["label", "dim"]
    group = Window.partitionBy(*place)
    numbered = tiles.select(*place, "tile", "low", "high").withColumn("i", F.row_number().over(group.orderBy("low", "high", "tile")))
    # The last tile that ends within reach; the one after it may still begin there.
    near = f"max(i) over (partition by label, dim order by high range between current row and {width!r}D following)"
    reach = F.expr(near) + 1
    last = F.least(reach, F.max("i").over(group))
    numbered = stored(numbered.select(*place, "tile", "i", last.alias("last")), "tile-order")
    # Spark judges a side before it is exploded, so the pairs are not broadcast but written at their true size.
    ahead = numbered.select(*place, "tile", F.explode(F.sequence("i", "last")).alias("i")).hint("merge")
    pairs = ahead.join(numbered.select(*place, "i", F.col("tile").alias("other")), [*place, "i"])
    return stored(pairs.select("tile", "other"), "tile-pairs")


def linked(
    x: np.ndarray, y: np.ndarray, basis: np.ndarray, threshold: float, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row of x, row of y) with a cosine of at least ``threshold``."""
    x_norm, y_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    px, py = (x / x_norm[:, None]) @ basis, (y / y_norm[:, None]) @ basis
    dim = x.shape[1]
    cuts = sorted({min(dim, c) for c in (8, 16, 32)} | {dim})
    suffix = [(np.sqrt((px[:, c:] ** 2).sum(axis=1)), np.sqrt((py[:, c:] ** 2).sum(axis=1))) for c in cuts]
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for start in range(0, len(x), step):
        part = px[start : start + step]
        total = part[:, : cuts[0]] @ py[:, : cuts[0]].T
        possible = total + np.outer(suffix[0][0][start : start + step], suffix[0][1]) >= threshold - SLACK
        rows, columns = np.nonzero(possible)
        rows, total = rows + start, total[possible]
        if same:
            above = rows < columns
            rows, columns, total = rows[above], columns[above], total[above]
        for begin, end, (sx, sy) in zip(cuts, cuts[1:], suffix[1:]):
            total = total + np.einsum("ij,ij->i", px[rows, begin:end], py[columns, begin:end])
            possible = total + sx[rows] * sy[columns] >= threshold - SLACK
            rows, columns, total = rows[possible], columns[possible], total[possible]
        exact = np.einsum("ij,ij->i", x[rows], y[columns]) / (x_norm[rows] * y_norm[columns])
        yield rows[exact >= threshold], columns[exact >= threshold]


def _spanning(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that ``pairs`` reach."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for a, b in pairs:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _compare(pairs: DataFrame, sent, threshold: float) -> DataFrame:
    """Per class of a pair of tiles its links there and a root that spans them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                def side(name: str, dtype: str) -> np.ndarray:
                    return np.frombuffer(batch.column(name)[row].as_buffer(), dtype=dtype)

                dim, same = batch.column("dim")[row].as_py(), batch.column("tile")[row] == batch.column("other")[row]
                x, y = (side(n, "<f8").reshape(-1, dim) for n in ("data", "other_data"))
                n = len(x)
                classes = side("classes", "<i8") if same else np.concatenate([side("classes", "<i8"), side("other_classes", "<i8")])
                copies_x, copies_y = side("copies", "<i8"), side("other_copies", "<i8")
                links, shift, found = np.zeros(len(classes), dtype=np.int64), 0 if same else n, []
                for a, b in linked(x, y, _basis(bases, dim), threshold, same):
                    np.add.at(links, a, copies_y[b])
                    np.add.at(links, b + shift, copies_x[a])
                    found.append((a, b + shift))
                root = _spanning(len(classes), found)
                hit = np.nonzero(links)[0]
                yield pa.record_batch(
                    [pa.array(classes[hit]), pa.array(links[hit]), pa.array(classes[root[hit]])], names=["class_id", "links", "root"]
                )

    return pairs.mapInArrow(run, FOUND)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows are linked when their labels are equal and the cosine is at least
    ``threshold``. Rows of one label and one vector are a single class with a
    count, so copies are never paired; a pair of tiles gives counts and a
    spanning forest, never its pairs. component_id is the smallest vec_id
    that links reach.

    A row whose label or vec_id is null, or whose vector is null, empty, zero
    or holds a null or non-finite value, links with nothing: n_links 0,
    component_id its own vec_id. Vectors of different length are not
    compared. Repeated rows link with each other; an empty table gives no
    rows; other columns are not read.
    """
    vectors = vectors.select(F.col("vec_id").cast("bigint"), "embedding", F.col("label").cast("bigint"))
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(pca_bases(vectors))
    marked = _marked(vectors, sent)
    classes = stored(
        marked.where("vec is not null").groupBy("label", "dim", "vec")
        .agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("copies"), F.min("lead").alias("lead"))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "vector-classes",
    )
    tiles = _tiles(classes, tile)
    blobs = ("classes", "copies", "data")
    others = tiles.select(F.col("tile").alias("other"), *[F.col(c).alias(f"other_{c}") for c in blobs])
    pairs = _close_tiles(tiles, threshold).join(tiles.select("tile", "dim", *blobs), "tile").join(others, "other")
    found = stored(_compare(pairs, sent, threshold), "tile-links")
    nodes = connected_components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    place = ["label", "dim"]
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    described = (
        classes.join(links, "class_id", "left").join(nodes, F.col("class_id") == F.col("node"), "left")
        .select(*place, "vec", "smallest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "class_id").alias("component"))
    )
    roots = described.groupBy("component").agg(F.min("smallest").alias("root"))
    named = stored(described.join(roots, "component").select(*place, "vec", "n", "root"), "vector-groups")
    component = F.coalesce("root", "vec_id")
    return marked.join(named, [*place, "vec"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
