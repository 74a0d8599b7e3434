"""Two models side by side, and ways to combine them.

Rows carry ``y_true``, ``y1`` and ``y2`` as label arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.operators.metrics import class_count, evaluate, ratio, stacked, tally
from labelweave.plans.sizing import as_array

# Fixed value: the lead in f1 from which one model is called better.
MARGIN = 0.05


def agreement(pairs: DataFrame, label_table: DataFrame) -> DataFrame:
    """Cells both models predict, neither, or only one; counts and rates."""
    both = F.size(F.array_intersect("y1", "y2"))
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(both).alias("both_positive"),
        F.sum(F.size("y1") - both).alias("only_model1"),
        F.sum(F.size("y2") - both).alias("only_model2"),
    ).withColumn("cells", F.col("n_docs") * class_count(label_table))
    one_sided = F.col("only_model1") + F.col("only_model2")
    negative = F.col("cells") - F.col("both_positive") - one_sided
    counts = sums.withColumn("both_negative", negative)
    names = ("both_positive", "both_negative", "only_model1", "only_model2")
    return counts.select(
        *names,
        *[(F.col(n) * 100.0 / F.col("cells")).alias(f"pct_{n}") for n in names],
        (1.0 - one_sided / F.col("cells")).alias("agreement_rate"),
        (one_sided / F.col("cells")).alias("disagreement_rate"),
    )


def per_class_comparison(pairs: DataFrame, label_table: DataFrame, tie: str = "model2") -> DataFrame:
    """f1 of both models, gap, agreement and the better one, per class.

    ``tie`` names the winner where both score the same.
    """
    def cell(label: Column) -> Column:
        t, a, b = (F.array_contains(F.col(c), label) for c in ("y_true", "y1", "y2"))
        return F.struct(
            label.alias("label"), t.cast("bigint").alias("y"), a.cast("bigint").alias("a"),
            b.cast("bigint").alias("b"), (t & a).cast("bigint").alias("ta"),
            (t & b).cast("bigint").alias("tb"), (a != b).cast("bigint").alias("differ"),
        )

    labels = F.array_union(F.array_union("y_true", "y1"), "y2")
    sums = (
        pairs.select(F.explode(F.transform(labels, cell)).alias("r")).select("r.*")
        .groupBy("label").agg(*[F.sum(c).alias(c) for c in ("y", "a", "b", "ta", "tb", "differ")])
    )
    n_docs = pairs.agg(F.count(F.lit(1))).scalar()
    full = label_table.select("label").join(sums, "label", "left").na.fill(0).withColumn("n_docs", n_docs)
    f1 = lambda hit, size: ratio(2.0 * F.col(hit), F.col(size) + F.col("y"))
    better = (
        F.when(F.col("f1_model1") > F.col("f1_model2"), "model1")
        .when(F.col("f1_model2") > F.col("f1_model1"), "model2").otherwise(tie)
    )
    return full.select(
        "label", f1("ta", "a").alias("f1_model1"), f1("tb", "b").alias("f1_model2"),
        (1.0 - F.col("differ") / F.col("n_docs")).alias("agreement"), F.col("y").alias("support"),
    ).withColumns({"f1_gap": F.abs(F.col("f1_model1") - F.col("f1_model2")), "better_model": better})


def union_labels() -> Column:
    return F.array_union("y1", "y2")


def intersection_labels() -> Column:
    return F.array_intersect("y1", "y2")


def mixed_labels(from_model2: Column) -> Column:
    """Model 2 on the listed classes, model 1 on all others."""
    return F.concat(F.array_except("y1", from_model2), F.array_intersect("y2", from_model2))


def model2_classes(comparison: DataFrame) -> Column:
    """Classes on which the comparison prefers model 2, as one array."""
    return as_array(comparison.where(F.col("better_model") == "model2"), "label")


def weighted_classes(comparison: DataFrame, margin: float = MARGIN) -> Column:
    """Classes left to model 2: all where model 1 does not lead by a margin."""
    leads = F.col("f1_model1") > F.col("f1_model2") + margin
    return as_array(comparison.where(~leads), "label")


def ensemble(pairs: DataFrame, strategy: str, comparison: DataFrame | None = None) -> DataFrame:
    """Add ``y_pred``. The class-wise strategies read ``comparison``, which
    should come from another split than the one that is scored."""
    if strategy == "union":
        return pairs.withColumn("y_pred", union_labels())
    if strategy == "intersection":
        return pairs.withColumn("y_pred", intersection_labels())
    if strategy not in ("best_per_class", "weighted"):
        raise ValueError(f"unknown strategy: {strategy}")
    if comparison is None:
        raise ValueError(f"{strategy} needs a per-class comparison")
    pick = model2_classes if strategy == "best_per_class" else weighted_classes
    return (
        pairs.withColumn("chosen", pick(comparison))
        .withColumn("y_pred", mixed_labels(F.col("chosen"))).drop("chosen")
    )


def metric_comparison(metrics: DataFrame, by: str, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """Value per model, difference and percent change."""
    long = metrics.unpivot([by], list(columns), "metric", "value")
    table = long.groupBy("metric").pivot(by, [first, second]).agg(F.first("value"))
    change = F.col(second) - F.col(first)
    return table.withColumns(
        {"difference": change, "pct_change": F.when(F.col(first) != 0, F.round(change / F.col(first) * 100, 1))}
    )


def improvements(comparison: DataFrame) -> DataFrame:
    """Change in f1 from model 1 to model 2 per class."""
    return comparison.select(
        "label", "f1_model1", "f1_model2",
        (F.col("f1_model2") - F.col("f1_model1")).alias("delta_f1"), "support",
    )


def largest_improvements(deltas: DataFrame, n: int = 10) -> DataFrame:
    return deltas.orderBy(F.desc("delta_f1"), "label").limit(n)


def largest_declines(deltas: DataFrame, n: int = 5) -> DataFrame:
    return deltas.orderBy("delta_f1", "label").limit(n)


def improvement_counts(deltas: DataFrame) -> DataFrame:
    d = F.col("delta_f1")
    return deltas.agg(
        F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("declined"),
        F.count_if(d == 0).alias("unchanged"),
    )


def complementary(comparison: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Classes where one model leads by more than the margin."""
    one, two = F.col("f1_model1"), F.col("f1_model2")
    leader = F.when(one > two + margin, "model1").when(two > one + margin, "model2")
    return comparison.withColumn("leader", leader).where(F.col("leader").isNotNull()).select(
        "leader", "label", "f1_model1", "f1_model2", "f1_gap", "support"
    )


def lowest_agreement(comparison: DataFrame, n: int = 10) -> DataFrame:
    return comparison.orderBy("agreement", "label").limit(n).select(
        "label", "f1_model1", "f1_model2", "agreement", "support"
    )


def jointly_weak(comparison: DataFrame, below: float = 0.5) -> DataFrame:
    weak = (F.col("f1_model1") < below) & (F.col("f1_model2") < below)
    return comparison.where(weak).select("label", "f1_model1", "f1_model2", "support")


def strategy_table(pairs: DataFrame, label_table: DataFrame, comparison: DataFrame) -> DataFrame:
    """Both models and three ensembles under the same metrics, in one pass."""
    chosen = pairs.withColumn("chosen", weighted_classes(comparison))
    options = {
        "model1": F.col("y1"), "model2": F.col("y2"), "union": union_labels(),
        "intersection": intersection_labels(), "weighted": mixed_labels(F.col("chosen")),
    }
    tallied = tally(stacked(chosen, options, "strategy"), by=["strategy"])
    return evaluate(tallied, label_table, by=["strategy"]).select(
        "strategy", "f1_micro", "f1_macro", F.col("precision_micro").alias("precision"),
        F.col("recall_micro").alias("recall"),
    )


def best_strategy(strategies: DataFrame, baseline: str = "model1") -> DataFrame:
    """The winner by micro f1 and its lead over the baseline in points."""
    base = strategies.where(F.col("strategy") == baseline).select("f1_micro").scalar()
    best = strategies.orderBy(F.desc("f1_micro"), "strategy").limit(1)
    return best.withColumn("gain_pp", (F.col("f1_micro") - base) * 100)
