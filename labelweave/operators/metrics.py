"""Multi-label evaluation.

A scored document is one row: ``y_true`` and ``y_pred`` as label arrays. Only
labels in either array are ever written out, true negatives follow by
subtraction, and documents without any label still count. One aggregation,
``tally``, feeds every metric: it folds all documents into one row per label
plus one row for the document-level sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The range of agreement between human annotators, the part of
# its lower end from which a review still pays, and the support classes.
HUMAN_LOW = 0.63
HUMAN_HIGH = 0.93
REVIEW_PART = 0.8
SUPPORT_TIERS = ((50, "<50"), (100, "50-100"), (500, "100-500"), (1000, "500-1000"), (None, "1000+"))

METRICS = (
    "f1_micro", "f1_macro", "f1_weighted", "f1_samples", "precision_micro", "precision_macro",
    "recall_micro", "recall_macro", "hamming_loss", "exact_match",
)
EPOCH_METRICS = ("f1_micro", "f1_macro", "f1_weighted", "precision_micro", "recall_micro")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0 where bottom is 0."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def predicted(cells: str, p: str, threshold: float, strict: bool = False) -> Column:
    """Labels of the cells whose probability reaches (or exceeds) a threshold."""
    hit = (lambda c: c[p] > threshold) if strict else (lambda c: c[p] >= threshold)
    return F.transform(F.filter(cells, hit), lambda c: c["label"])


def tally(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """(by, label, tp, fp, fn, n_docs, f1_sum, n_exact), folded in one pass.

    The row with a null label carries the document sums, all other rows the
    cell counts of one label. Both are partially aggregated before the
    shuffle, which sees at most one row per label and task.
    """
    true, pred = F.array_distinct(y_true), F.array_distinct(y_pred)
    base = scored.select(*by, true.alias("t"), pred.alias("p"))
    zero = F.lit(0).cast("bigint")

    def cell(label: Column) -> Column:
        in_true, in_pred = F.array_contains(F.col("t"), label), F.array_contains(F.col("p"), label)
        return F.struct(
            label.alias("label"),
            (in_true & in_pred).cast("bigint").alias("tp"),
            (~in_true & in_pred).cast("bigint").alias("fp"),
            (in_true & ~in_pred).cast("bigint").alias("fn"),
            zero.alias("n_docs"), F.lit(0.0).alias("f1_sum"), zero.alias("n_exact"),
        )

    common = F.size(F.array_intersect("t", "p"))
    sizes = F.size("t") + F.size("p")
    document = F.struct(
        F.lit(None).cast("string").alias("label"),
        zero.alias("tp"), zero.alias("fp"), zero.alias("fn"),
        F.lit(1).cast("bigint").alias("n_docs"),
        ratio(2.0 * common, sizes).alias("f1_sum"),
        (common * 2 == sizes).cast("bigint").alias("n_exact"),
    )
    rows = F.concat(F.transform(F.array_union("t", "p"), cell), F.array(document))
    return (
        base.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_docs", "f1_sum", "n_exact")])
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1, support and predicted_count."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2.0 * tp, 2 * tp + fp + fn),
            "support": tp + fn,
            "predicted_count": tp + fp,
        }
    )


def class_count(label_table: DataFrame) -> Column:
    return label_table.agg(F.count(F.lit(1))).scalar()


def only_known(tallied: DataFrame, label_table: DataFrame) -> DataFrame:
    """The tally as it is; a label that ``label_table`` lacks fails the query.

    Such a label would count in some metrics and not in others. Cut the
    documents' labels to the class table first, as ``keep_viable`` does.
    """
    known = label_table.select("label", F.lit(True).alias("known"))
    stray = F.raise_error(F.concat(F.lit("label outside the class table: "), F.col("label"))).cast("bigint")
    checked = F.when(F.col("label").isNull() | F.col("known"), F.col("tp")).otherwise(stray)
    return tallied.join(known, "label", "left").withColumn("tp", checked).drop("known")


def evaluate(tallied: DataFrame, label_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All overall metrics, one row per ``by``.

    The macro means divide by the number of classes, so a class that never
    occurs counts as 0 without being listed.
    """
    scores = with_scores(only_known(tallied, label_table))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    sums = scores.groupBy(*by).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.sum("n_docs").alias("n_docs"), F.sum("f1_sum").alias("f1_sum"), F.sum("n_exact").alias("n_exact"),
        F.sum("precision").alias("p_sum"), F.sum("recall").alias("r_sum"), F.sum("f1").alias("f_sum"),
        F.sum(F.col("f1") * F.col("support")).alias("fw_sum"),
    ).withColumn("n_labels", class_count(label_table))
    c = F.col
    return sums.select(
        *by,
        ratio(2.0 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1_micro"),
        ratio(c("f_sum"), c("n_labels")).alias("f1_macro"),
        ratio(c("fw_sum"), c("tp") + c("fn")).alias("f1_weighted"),
        ratio(c("f1_sum"), c("n_docs")).alias("f1_samples"),
        ratio(c("tp"), c("tp") + c("fp")).alias("precision_micro"),
        ratio(c("p_sum"), c("n_labels")).alias("precision_macro"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall_micro"),
        ratio(c("r_sum"), c("n_labels")).alias("recall_macro"),
        ratio(c("fp") + c("fn"), c("n_docs") * c("n_labels")).alias("hamming_loss"),
        ratio(c("n_exact"), c("n_docs")).alias("exact_match"),
    )


def per_class(tallied: DataFrame, label_table: DataFrame) -> DataFrame:
    """Metrics of every class, the ones that never occur included."""
    counts = only_known(tallied.where(F.col("label").isNotNull()), label_table).select("label", "tp", "fp", "fn")
    full = label_table.select("label").join(counts, "label", "left")
    filled = full.na.fill(0, ["tp", "fp", "fn"])
    return with_scores(filled).select("label", "precision", "recall", "f1", "support", "predicted_count")


def by_support(classes: DataFrame) -> DataFrame:
    return classes.orderBy(F.desc("support"), "label")


def top_classes(classes: DataFrame, n: int = 10, metric: str = "f1") -> DataFrame:
    return classes.orderBy(F.desc(metric), "label").limit(n)


def bottom_classes(classes: DataFrame, n: int = 10, metric: str = "f1") -> DataFrame:
    return classes.orderBy(metric, "label").limit(n)


def classification_report(classes: DataFrame) -> DataFrame:
    return classes.select(
        "label", "precision", "recall", F.col("f1").alias("f1_score"), "support"
    ).orderBy("label")


def feasibility(classes: DataFrame, low: float = HUMAN_LOW, high: float = HUMAN_HIGH) -> DataFrame:
    """Which classes reach the agreement of human annotators."""
    f1 = F.col("f1")
    return classes.select(
        "label", "f1", "support",
        (f1 >= low).alias("automation_feasible"),
        (f1 >= high).alias("high_confidence"),
        ((f1 >= low * REVIEW_PART) & (f1 < low)).alias("needs_review"),
    )


def feasible_classes(flags: DataFrame, n: int | None = None) -> DataFrame:
    """Feasible classes, best f1 first, or the n with most support."""
    feasible = flags.where("automation_feasible").select("label", "f1", "support")
    if n is None:
        return feasible.orderBy(F.desc("f1"), "label")
    return feasible.orderBy(F.desc("support"), "label").limit(n)


def feasibility_counts(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, category, n) for the four feasibility categories."""
    feasible, review = F.col("automation_feasible"), F.col("needs_review")
    row = flags.groupBy(*by).agg(
        F.count_if(feasible).alias("feasible"),
        F.count_if("high_confidence").alias("high_confidence"),
        F.count_if(review).alias("needs_review"),
        F.count_if(~feasible & ~review).alias("not_feasible"),
    )
    names = ["feasible", "high_confidence", "needs_review", "not_feasible"]
    return row.unpivot(list(by), names, "category", "n")


def feasibility_comparison(flags: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    """Category counts side by side with the change from first to second."""
    first, second = names
    counts = feasibility_counts(flags, [by])
    return (
        counts.groupBy("category").pivot(by, [first, second]).agg(F.sum("n"))
        .withColumn("change", F.col(second) - F.col(first))
    )


def deployment_tiers(flags: DataFrame) -> DataFrame:
    """How many classes can run alone, with help, or not; expected gain."""
    feasible, review = F.col("automation_feasible"), F.col("needs_review")
    return flags.agg(
        F.count_if("high_confidence").alias("full_automation"),
        (F.count_if(feasible) - F.count_if("high_confidence")).alias("assisted"),
        F.count_if(review).alias("human_review"),
        F.count_if(~feasible & ~review).alias("human_only"),
        (F.count_if(feasible) / F.count(F.lit(1))).alias("gain"),
    )


def volume_by_feasibility(flags: DataFrame) -> DataFrame:
    """Share of all label assignments per feasibility tier."""
    tier = (
        F.when(F.col("high_confidence"), "high_confidence")
        .when(F.col("automation_feasible"), "feasible")
        .when(F.col("needs_review"), "needs_review")
        .otherwise("not_feasible")
    )
    total = flags.agg(F.sum("support")).scalar()
    return flags.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("support").alias("volume")
    ).withColumn("share", F.col("volume") / total)


def support_tiers(classes: DataFrame) -> DataFrame:
    """Mean and spread of f1 by support; classes without support fall out."""
    support, tier = F.col("support"), None
    for upper, name in SUPPORT_TIERS:
        inside = F.lit(True) if upper is None else support <= upper
        tier = F.when(inside, name) if tier is None else tier.when(inside, name)
    return classes.where(support > 0).groupBy(tier.alias("tier")).agg(
        F.round(F.avg("f1"), 3).alias("f1_mean"),
        F.round(F.stddev_samp("f1"), 3).alias("f1_std"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def f1_band(f1: Column) -> Column:
    return F.when(f1 >= HUMAN_LOW, "automatable").when(f1 >= 0.5, "review").otherwise("human")


def f1_values(classes: DataFrame) -> DataFrame:
    """(value, n) of f1 over classes, ready for a histogram."""
    return classes.groupBy(F.col("f1").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def stacked(scored: DataFrame, predictions: Mapping[str, Column], name: str = "config") -> DataFrame:
    """Each document once per named prediction: (name, y_true, y_pred)."""
    options = F.array(
        *[F.struct(F.lit(k).alias(name), v.alias("y_pred")) for k, v in predictions.items()]
    )
    return scored.select("y_true", F.explode(options).alias("o")).select("y_true", "o.*")


def compare_configurations(
    metrics: DataFrame, by: str, names: Sequence[str], baseline: str, columns: Sequence[str] = METRICS
) -> DataFrame:
    """Metric by configuration, and each one's gap to the baseline."""
    long = metrics.unpivot([by], list(columns), "metric", "value")
    table = long.groupBy("metric").pivot(by, list(names)).agg(F.first("value"))
    gaps = {f"gap_{n}": F.col(n) - F.col(baseline) for n in names if n != baseline}
    return table.withColumns(gaps)


def predictions_per_document(scored: DataFrame, y_pred: str = "y_pred") -> DataFrame:
    """(value, n): documents by number of predicted labels."""
    return scored.groupBy(F.size(y_pred).cast("bigint").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def predictions_per_document_stats(values: DataFrame) -> DataFrame:
    none = F.sum(F.when(F.col("value") == 0, F.col("n")).otherwise(0))
    return values.agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean_predictions"),
        F.max("value").alias("max_predictions"),
        none.alias("n_without"),
        (none * 100.0 / F.sum("n")).alias("pct_without"),
    )
