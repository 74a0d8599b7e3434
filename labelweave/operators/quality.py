"""Duplicates, cohort comparisons and length distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from labelweave.functions.stats import t_p_value
from labelweave.functions.text import content_digest


def text_copies(texts: DataFrame) -> DataFrame:
    """(digest, n): documents per distinct text.

    Grouped by the 32-byte digest, so whole texts stay out of the shuffle and
    a text copied into a third of the corpus is one row per task.
    """
    return texts.groupBy(content_digest(F.col("text")).alias("digest")).agg(
        F.count(F.lit(1)).alias("n")
    )


def duplicate_summary(texts: DataFrame) -> DataFrame:
    repeated = F.col("n") > 1
    n_ids = texts.agg(F.countDistinct("doc_id")).scalar()
    return text_copies(texts).agg(
        F.sum("n").alias("n_docs"),
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(repeated).alias("n_repeated_texts"),
        F.coalesce(F.sum(F.when(repeated, F.col("n") - 1)), F.lit(0)).alias("n_extra_copies"),
    ).withColumn("n_ids", n_ids)


def duplicate_histogram(texts: DataFrame) -> DataFrame:
    """(copies, n_texts) for texts that occur more than once."""
    return (
        text_copies(texts).where(F.col("n") > 1)
        .groupBy(F.col("n").alias("copies")).agg(F.count(F.lit(1)).alias("n_texts"))
    )


def duplicate_label_consistency(docs: DataFrame) -> DataFrame:
    """Repeated texts whose copies agree, or differ, in their label list; over (digest, labels)."""
    per_variant = docs.groupBy("digest", F.sort_array("labels").alias("labels")).agg(F.count(F.lit(1)).alias("n"))
    per_text = per_variant.groupBy("digest").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("variants")
    )
    return per_text.where(F.col("n") > 1).agg(
        F.count_if(F.col("variants") == 1).alias("n_consistent"),
        F.count_if(F.col("variants") > 1).alias("n_inconsistent"),
    )


def cohort_profile(counted: DataFrame, cohort: Column) -> DataFrame:
    """Sections and words per cohort, over (n_words, n_sections) documents."""
    by_length = counted.groupBy(cohort.alias("cohort"), "n_words").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_sections").alias("sections")
    )
    return by_length.groupBy("cohort").agg(
        F.sum("n").alias("n_docs"),
        (F.sum("sections") / F.sum("n")).alias("avg_sections"),
        (F.sum(F.col("n_words") * F.col("n")) / F.sum("n")).alias("avg_words"),
        F.min("n_words").alias("min_words"),
        F.max("n_words").alias("max_words"),
        F.percentile("n_words", F.lit(0.5), F.col("n")).alias("median_words"),
    )


def t_test(df: DataFrame, value: Column, cohort: Column) -> DataFrame:
    """Student's two-sample test with pooled variance, cohort against rest."""
    value = value.cast("double")
    inside, outside = F.when(cohort, value), F.when(~cohort, value)
    sums = df.agg(
        F.count(inside).alias("n1"), F.avg(inside).alias("mean1"), F.var_samp(inside).alias("v1"),
        F.count(outside).alias("n2"), F.avg(outside).alias("mean2"), F.var_samp(outside).alias("v2"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / F.col("dof")
    spread = F.sqrt(F.col("pooled") * (1.0 / n1 + 1.0 / n2))
    t = F.when(spread > 0, (F.col("mean1") - F.col("mean2")) / spread)
    return (
        sums.withColumn("dof", n1 + n2 - 2).withColumn("pooled", pooled)
        .select("n1", "n2", "mean1", "mean2", "dof", t.alias("t"))
    )


def with_p_value(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", t_p_value(F.col("t"), F.col("dof").cast("double")))


def anomaly_counts(counted: DataFrame, min_words: int = 10) -> DataFrame:
    """Over (n_words, n_sections, sections_empty) documents."""
    return counted.agg(
        F.count_if(F.col("n_words") < min_words).alias("n_short"),
        F.count_if(F.col("n_sections") == 0).alias("n_without_sections"),
        F.count_if("sections_empty").alias("n_empty_sections"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n): a distribution in as many rows as there are values."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram(values: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins from least to greatest value over (value, n).

    The last bin is closed on the right; a constant is centred in a range of
    width one. Empty bins are kept.
    """
    limits = values.agg(F.min("value").cast("double").alias("a"), F.max("value").cast("double").alias("b"))
    limits = limits.select(
        F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"),
        F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"),
    )
    low, high = limits.select("a").scalar(), limits.select("b").scalar()
    placed = values.withColumns({"a": low, "b": high})
    position = F.floor((F.col("value") - F.col("a")) * bins / (F.col("b") - F.col("a")))
    counts = placed.groupBy(F.least(position, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(
        F.sum("n").alias("n")
    )
    width = (F.col("b") - F.col("a")) / bins
    edges = limits.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = edges.select(
        F.col("bin").cast("bigint").alias("bin"),
        (F.col("a") + F.col("bin") * width).alias("low"),
        (F.col("a") + (F.col("bin") + 1) * width).alias("high"),
    )
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def length_summary(values: DataFrame) -> DataFrame:
    """Mean, median, least and greatest over (value, n)."""
    return values.agg(
        F.sum("n").alias("n_docs"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("value", F.lit(0.5), F.col("n")).alias("median"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def window_coverage(values: DataFrame, windows: Sequence[int] = (512, 1024, 2048, 4096)) -> DataFrame:
    """Documents no longer than each window, over (value, n)."""
    inside = [F.struct(F.lit(w).cast("bigint").alias("window"),
                       F.coalesce(F.sum(F.when(F.col("value") <= w, F.col("n"))), F.lit(0)).alias("n_docs"))
              for w in windows]
    row = values.agg(F.array(*inside).alias("rows"), F.sum("n").alias("total"))
    return row.select(F.explode("rows").alias("r"), "total").select(
        "r.window", "r.n_docs", (F.col("r.n_docs") * 100.0 / F.col("total")).alias("pct")
    )


def cumulative_distribution(values: DataFrame) -> DataFrame:
    """(value, n, pct): share of documents no longer than each value.

    The running sum is over distinct values, at most as many as the longest
    document has words, whatever the number of documents.
    """
    total = values.agg(F.sum("n")).scalar()
    running = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("cumulative", running).withColumn(
        "pct", F.col("cumulative") * 100.0 / total
    )
