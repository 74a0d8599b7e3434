"""Probability thresholds: sweeps, one per corpus or one per class.

Cells are placed in the interval of the threshold grid they fall in and
counted once; every threshold's counts are sums over those few intervals, so
a sweep costs one pass whatever the length of the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators.metrics import class_count, predicted, ratio
from labelweave.plans.sizing import as_array

# Fixed values, in thousandths: the two global grids and the per-class grid.
SWEEP_GRID = tuple(range(100, 901, 100))
EVALUATION_GRID = tuple(range(100, 801, 100))
CLASS_GRID = tuple(range(100, 901, 50))
DEFAULT_THRESHOLD = 500


def interval(p: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of an ascending grid the probability reaches."""
    return reduce(lambda a, b: a + b, [(p >= g).cast("int") for g in grid])


def _placed(scored: DataFrame, place: Callable[[Column], Column], nowhere: Column, by: Sequence[str], cells: str) -> DataFrame:
    """(by, label, k, n, pos): cells and true ones among them by the place ``k`` of their probabilities.

    True labels without a cell are at ``nowhere``.
    """
    def seen(c: Column) -> Column:
        true = F.array_contains(F.col("y_true"), c["label"]).cast("bigint")
        return F.struct(c["label"].alias("label"), place(c).alias("k"), true.alias("y"))

    def missed(label: Column) -> Column:
        return F.struct(label.alias("label"), nowhere.alias("k"), F.lit(1).cast("bigint").alias("y"))

    listed = F.transform(F.col(cells), lambda c: c["label"])
    rows = F.concat(
        F.transform(F.col(cells), seen),
        F.transform(F.array_except("y_true", listed), missed),
    )
    return (
        scored.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
        .groupBy(*by, "label", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    )


def sweep_counts(
    scored: DataFrame, p: str, grid: Sequence[float], by: Sequence[str] = (), cells: str = "cells"
) -> DataFrame:
    """(by, label, threshold, tp, n_pred, support) for every grid threshold.

    ``cells`` may list every class or only those with a probability worth
    keeping; true labels without a cell still count as support.
    """
    grid = sorted(grid)
    return _reached(_placed(scored, lambda c: interval(c[p], grid), F.lit(0), by, cells), grid, by)


def _reached(placed: DataFrame, grid: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The counts of every threshold from those of the intervals between them."""
    aggregates = [F.sum("pos").alias("support")]
    for i in range(1, len(grid) + 1):
        reached = F.col("k") >= i
        aggregates.append(F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias(f"tp{i}"))
        aggregates.append(F.sum(F.when(reached, F.col("n")).otherwise(0)).alias(f"n{i}"))
    wide = placed.groupBy(*by, "label").agg(*aggregates)
    points = F.array(
        *[
            F.struct(F.lit(g).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("n_pred"))
            for i, g in enumerate(grid, 1)
        ]
    )
    return wide.select(*by, "label", "support", F.explode(points).alias("r")).select(
        *by, "label", "r.threshold", "r.tp", "r.n_pred", "support"
    )


def point_f1() -> Column:
    return ratio(2.0 * F.col("tp"), F.col("n_pred") + F.col("support"))


def threshold_sweep(counts: DataFrame, label_table: DataFrame, n_docs: Column) -> DataFrame:
    """Metrics at every global threshold, with mean predictions per document."""
    sums = counts.groupBy("threshold").agg(
        F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("support").alias("support"),
        F.sum(point_f1()).alias("f_sum"),
    ).withColumns({"n_labels": class_count(label_table), "n_docs": n_docs})
    return sums.select(
        "threshold",
        point_f1().alias("f1_micro"),
        ratio(F.col("f_sum"), F.col("n_labels")).alias("f1_macro"),
        ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(F.col("n_pred"), F.col("n_docs")).alias("avg_preds"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the best micro f1."""
    return sweep.orderBy(F.desc("f1_micro"), "threshold").limit(1)


def document_count(scored: DataFrame) -> Column:
    return scored.agg(F.count(F.lit(1))).scalar()


def per_class_thresholds(
    counts: DataFrame, label_table: DataFrame, n_docs: Column,
    default: float = DEFAULT_THRESHOLD, by: Sequence[str] = (), grid: Sequence[float] | None = None,
) -> DataFrame:
    """The best threshold of each class, lowest first among equals.

    Thresholds that select no document or every document are left out; a
    class where no threshold scores keeps the default. With a ``grid`` only
    its points are chosen from; ``counts`` may then hold the default as well,
    which is scored but not chosen.
    """
    useful = (F.col("n_pred") > 0) & (F.col("n_pred") < F.col("n_docs"))
    points = counts.withColumn("n_docs", n_docs).withColumn("f1", F.when(useful, point_f1()))
    choosable = F.lit(True) if grid is None else F.col("threshold").isin(*grid)
    best = F.max(
        F.when(choosable & (F.col("f1") > 0), F.struct(F.col("f1"), (-F.col("threshold")).alias("minus")))
    )
    at_default = F.max(F.when(F.col("threshold") == default, F.col("f1")))
    chosen = points.groupBy(*by, "label").agg(
        best.alias("best"), at_default.alias("f1_default"), F.max("support").alias("support")
    )
    if by:
        full = chosen
    else:
        full = label_table.select("label").join(chosen, "label", "left")
    zero = F.lit(0.0)
    f1_default, f1_best = F.coalesce("f1_default", zero), F.coalesce(F.col("best.f1"), zero)
    return full.select(
        *by, "label",
        F.coalesce(-F.col("best.minus"), F.lit(default)).alias("threshold"),
        f1_default.alias("f1_default"),
        f1_best.alias("f1_best"),
        (f1_best - f1_default).alias("improvement"),
        F.coalesce("support", F.lit(0)).alias("support"),
    )


def decisions(scored: DataFrame, p: str, threshold: float = DEFAULT_THRESHOLD, strict: bool = False, cells: str = "cells") -> DataFrame:
    """(doc_id, ones, n_zeros): the labels decided as 1, and how many are 0."""
    ones = predicted(cells, p, threshold, strict)
    return scored.select("doc_id", ones.alias("ones"), (F.size(cells) - F.size(ones)).cast("bigint").alias("n_zeros"))


def apply_class_thresholds(scored: DataFrame, thresholds: DataFrame, p: str, cells: str = "cells") -> DataFrame:
    """Add ``y_pred`` with each class held to its own threshold.

    The thresholds travel as one class-ordered array next to the cells, so
    each document is decided inside its row. Cells out of class order, or of
    other classes, fail the query.
    """
    pairs = as_array(
        thresholds, F.struct(F.col("label"), F.col("threshold")), order="label"
    )

    def decide(c: Column, t: Column) -> Column:
        aligned = c["label"].eqNullSafe(t["label"])
        hit = F.when(c[p] >= t["threshold"], c["label"])
        return F.when(aligned, hit).otherwise(F.raise_error(F.lit("cells and thresholds differ in class")))

    with_pairs = scored.withColumn("thresholds", pairs)
    return with_pairs.withColumn(
        "y_pred", F.array_compact(F.zip_with(F.col(cells), F.col("thresholds"), decide))
    ).drop("thresholds")


def threshold_summary(thresholds: DataFrame) -> DataFrame:
    """Count, mean, spread and quartiles of the chosen thresholds."""
    t = F.col("threshold").cast("double")
    return thresholds.agg(
        F.count(F.lit(1)).alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"),
        F.min(t).alias("min"), F.percentile(t, 0.25).alias("q25"), F.percentile(t, 0.5).alias("median"),
        F.percentile(t, 0.75).alias("q75"), F.max(t).alias("max"),
    )


def most_improved(thresholds: DataFrame, n: int = 10) -> DataFrame:
    return thresholds.orderBy(F.desc("improvement"), "label").limit(n)


def probability_histogram(scored: DataFrame, p: str, bins: int = 50, cells: str = "cells") -> DataFrame:
    """(bin, low, high, n) over all cells, binned before they are grouped.

    One pass finds the range and one counts, in as many groups as there are
    bins, whatever the number of different probabilities.
    """
    each = F.transform(F.col(cells), lambda c: c[p].cast("double"))
    ends = scored.agg(F.min(F.array_min(each)).alias("lo"), F.max(F.array_max(each)).alias("hi"))
    lo, hi = (ends.select(c).scalar() for c in ("lo", "hi"))
    marked = scored.select(F.explode(each).alias("v"), lo.alias("lo"), hi.alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) * bins / width), F.lit(bins - 1))).otherwise(0)
    counted = marked.groupBy(place.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda b: F.col("lo") + b * ((F.col("hi") - F.col("lo")) / bins)
    all_bins = scored.sparkSession.range(bins).select(F.col("id").alias("bin"), lo.alias("lo"), hi.alias("hi"))
    return all_bins.join(counted, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n")
    )


def blend_counts(
    scored: DataFrame, alphas: Sequence[float], grid: Sequence[float], p1: str = "p1", p2: str = "p2", cells: str = "cells",
) -> DataFrame:
    """(alpha, label, threshold, tp, n_pred, support) for every weight and grid threshold, from one reading.

    A cell's place is where its pair (p1, p2) lies among the lines
    alpha * p1 + (1 - alpha) * p2 = threshold: the interval it reaches under
    each weight. Cells are counted by place before they move, once for all
    weights; the number of places depends on the lines, not on the documents.
    """
    grid = sorted(grid)
    reached = lambda c, a: interval(F.lit(float(a)) * c[p1] + (1 - F.lit(float(a))) * c[p2], grid).cast("smallint")
    place = lambda c: F.array(*[reached(c, a) for a in alphas])
    nowhere = F.array(*[F.lit(0).cast("smallint") for _ in alphas])
    places = _placed(scored, place, nowhere, (), cells)
    named = F.arrays_zip(F.array(*[F.lit(float(a)) for a in alphas]).alias("alpha"), F.col("k").alias("k"))
    each = places.select("label", "n", "pos", F.explode(named).alias("at")).select("at.alpha", "label", "at.k", "n", "pos")
    # Places that differ under another weight only are one interval here.
    folded = each.groupBy("alpha", "label", "k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return _reached(folded, grid, ["alpha"])


def per_class_blend(scored: DataFrame, label_table: DataFrame, alphas: Sequence[float], grid: Sequence[float] = CLASS_GRID) -> DataFrame:
    """The weight and threshold per class with the best f1.

    Ties go to the lowest weight. A class no blend can score keeps weight 0
    and the default threshold.
    """
    n_docs = document_count(scored)
    counts = blend_counts(scored, alphas, grid)
    best = per_class_thresholds(counts, label_table, n_docs, by=["alpha"]).groupBy("label").agg(
        F.max(F.struct("f1_best", (-F.col("alpha")).alias("minus"), "threshold")).alias("b")
    )
    return label_table.select("label").join(best, "label", "left").select(
        "label",
        F.coalesce(-F.col("b.minus") + F.lit(0.0), F.lit(0.0)).alias("alpha"),
        F.coalesce("b.threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce("b.f1_best", F.lit(0.0)).alias("f1"),
    )
