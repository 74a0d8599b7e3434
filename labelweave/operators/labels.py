"""Label counts, frequency tiers and labels-per-document statistics.

Documents are folded twice before anything else: into ``label_counts`` (one
row per label) or into ``label_sets`` (one row per distinct label list). Both
are built with partial aggregation, so a label that holds a third of all
assignments costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.plans.durable import stored

# The smallest count of a common and of a moderate label.
COMMON = 100
MODERATE = 10

# How many labels of a document are held in a row, about, where they come as rows.
LONGEST = 4096

# Size of a sketch of distinct labels: two to this power of registers.
SKETCH_LG_K = 14


def label_counts(docs: DataFrame) -> DataFrame:
    """(label, n): occurrences over the corpus."""
    return docs.select(F.explode("labels").alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


def label_sets(docs: DataFrame) -> DataFrame:
    """(labels, n_docs): distinct sorted label lists with their documents.

    Of (doc_id, label) rows, which may repeat, it is (labels, n_docs, list): a
    list of more than about ``LONGEST`` labels comes as several rows that
    have its number in ``list``, so no row and no task holds it whole. Such
    lists are one each, be they alike or not.
    """
    if "label" in docs.columns:
        return _sets_of_rows(docs)
    return docs.groupBy(F.sort_array("labels").alias("labels")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )


def _sets_of_rows(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("doc_id").agg(F.count("label").alias("n")).where(F.col("n") > LONGEST)
    long = sizes.select(F.col("doc_id").alias("long"), F.ceil(F.col("n") / LONGEST).alias("pieces"), F.monotonically_increasing_id().alias("list"))
    # At most one of ``LONGEST`` rows.
    marked = rows.join(F.broadcast(stored(long, "long-lists")), F.col("doc_id").eqNullSafe(F.col("long")), "left")
    piece = F.pmod(F.xxhash64("label"), F.col("pieces"))
    lists = marked.groupBy("doc_id", "list", piece.alias("piece")).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return lists.groupBy("labels", "list").agg(F.count(F.lit(1)).alias("n_docs")).select("labels", "n_docs", "list")


def label_distribution(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), "label")


def distinct_labels(docs: DataFrame, approximate: bool = False) -> DataFrame:
    labels = docs.select(F.explode("labels").alias("label"))
    count = F.approx_count_distinct("label") if approximate else F.countDistinct("label")
    return labels.agg(count.alias("n_labels"))


def label_sketches(docs: DataFrame, part: str = "part", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(part, sketch): a HyperLogLog sketch of the labels of each part of a corpus (part, labels).

    Kept beside the parts, sketches add up: a new part costs one pass over it
    alone, and any choice of parts is counted without reading them again. A
    part without labels has an empty sketch.
    """
    labels = docs.select(F.col(part).alias("part"), F.explode_outer("labels").alias("label"))
    return labels.groupBy("part").agg(F.hll_sketch_agg("label", lg_k).alias("sketch"))


def sketched_labels(sketches: DataFrame) -> DataFrame:
    """One row: about how many distinct labels the parts of ``sketches`` have together."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n_labels"))


def sketch_error(lg_k: int = SKETCH_LG_K) -> float:
    """Three standard errors of a union of sketches, as a share of the count."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def ranked_labels(counts: DataFrame) -> DataFrame:
    """(rank, label) in alphabetical order, one row per class."""
    rank = F.row_number().over(Window.orderBy("label"))
    return counts.select(rank.cast("bigint").alias("rank"), "label")


def top_labels(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("n"), "label").limit(n)


def bottom_labels(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy("n", "label").limit(n)


def with_share(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Add each label's share of documents in percent."""
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct_docs", F.col("n") * 100.0 / n_docs)


def imbalance_ratio(counts: DataFrame) -> DataFrame:
    """Largest over smallest label count; infinite where there is no label."""
    ratio = F.max("n") / F.min("n")
    return counts.agg(F.coalesce(ratio, F.lit(float("inf"))).alias("imbalance_ratio"))


def with_tier(counts: DataFrame, common: int = COMMON, moderate: int = MODERATE) -> DataFrame:
    n = F.col("n")
    tier = F.when(n >= common, "common").when(n >= moderate, "moderate").otherwise("rare")
    return counts.withColumn("tier", tier)


def taxonomy_summary(counts: DataFrame, common: int = COMMON, moderate: int = MODERATE) -> DataFrame:
    tier = with_tier(counts, common, moderate)
    is_common = F.col("tier") == "common"
    return tier.agg(
        F.count(F.lit(1)).alias("total_unique"),
        F.count_if(is_common).alias("common_count"),
        F.count_if(F.col("tier") == "moderate").alias("moderate_count"),
        F.count_if(F.col("tier") == "rare").alias("rare_count"),
        F.count_if(F.col("n") == 1).alias("singleton_count"),
        F.sum("n").alias("total_assignments"),
        (F.sum(F.when(is_common, F.col("n")).otherwise(0)) / F.sum("n")).alias("common_coverage"),
    )


def modeling_subset(counts: DataFrame, min_samples: int = 50) -> DataFrame:
    return counts.where(F.col("n") >= min_samples)


def subset_coverage(counts: DataFrame, min_samples: int = 50) -> DataFrame:
    """How many labels reach ``min_samples`` and what they cover."""
    viable = F.col("n") >= min_samples
    return counts.agg(
        F.count_if(viable).alias("n_viable"),
        (F.sum(F.when(viable, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
    )


def threshold_counters(counts: DataFrame, moderate: int = MODERATE, common: int = COMMON) -> DataFrame:
    n = F.col("n")
    return counts.agg(
        F.count_if(n == 1).alias("n_once"),
        F.count_if(n < moderate).alias("n_below_moderate"),
        F.count_if(n < common).alias("n_below_common"),
        F.count_if(n >= common).alias("n_common"),
    )


def labels_per_document(sets: DataFrame) -> DataFrame:
    """(k, n_docs, pct): documents with k labels, k = 0 included."""
    sizes = sets.groupBy(F.size("labels").cast("bigint").alias("k")).agg(
        F.sum("n_docs").alias("n_docs")
    )
    total = sets.agg(F.sum("n_docs")).scalar()
    return sizes.withColumn("pct", F.col("n_docs") * 100.0 / total)


def labels_per_document_stats(sets: DataFrame) -> DataFrame:
    k = F.size("labels").cast("bigint")
    sizes = sets.groupBy(k.alias("k")).agg(F.sum("n_docs").alias("n_docs"))
    return sizes.agg(
        F.min("k").alias("min_labels"),
        F.max("k").alias("max_labels"),
        (F.sum(F.col("k") * F.col("n_docs")) / F.sum("n_docs")).alias("mean_labels"),
        F.percentile("k", F.lit(0.5), F.col("n_docs")).alias("median_labels"),
    )


def label_cardinality_shares(sets: DataFrame) -> DataFrame:
    """Zero-, single- and multi-label documents, counts and percent."""
    k, n = F.size("labels"), F.col("n_docs")
    picks: Mapping[str, Column] = {"zero": k == 0, "single": k == 1, "multi": k > 1}
    total = F.sum("n_docs")
    columns = [total.alias("n_docs")]
    for name, condition in picks.items():
        count = F.sum(F.when(condition, n).otherwise(0))
        columns += [count.alias(f"n_{name}"), (count * 100.0 / total).alias(f"pct_{name}")]
    return sets.agg(*columns)


def top_and_other(counts: DataFrame, n: int = 8) -> DataFrame:
    """The n largest labels and one row for the rest, percent of assignments."""
    top = counts.orderBy(F.desc("n"), "label").limit(n).select("label", F.lit(True).alias("kept"))
    total = counts.agg(F.sum("n")).scalar()
    bucket = F.when(F.col("kept"), F.col("label")).otherwise("Other")
    return (
        counts.join(F.broadcast(top), "label", "left")  # n rows
        .groupBy(bucket.alias("label"), F.coalesce("kept", F.lit(False)).alias("is_label"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_labels"))
        .withColumn("pct", F.col("n") * 100.0 / total)
    )


def corpus_statistics(counted: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row about the corpus from (n_words, n_paragraphs) per document.

    The median comes from the table of distinct lengths, which is as long as
    the longest document, not as the corpus.
    """
    by_length = counted.groupBy("n_words").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_paragraphs").alias("paragraphs")
    )
    words = F.col("n_words") * F.col("n")
    stats = by_length.agg(
        F.sum("n").alias("n_docs"),
        F.sum("paragraphs").alias("total_paragraphs"),
        (F.sum("paragraphs") / F.sum("n")).alias("avg_paragraphs"),
        (F.sum(words) / F.sum("n")).alias("avg_words"),
        F.min("n_words").alias("min_words"),
        F.max("n_words").alias("max_words"),
        F.percentile("n_words", F.lit(0.5), F.col("n")).alias("median_words"),
    )
    if counts is None:
        return stats
    return stats.withColumn("n_labels", counts.agg(F.count(F.lit(1))).scalar())


def modeling_observations(counted: DataFrame, counts: DataFrame) -> DataFrame:
    """What a modeller asks first, in one row."""
    ratio = imbalance_ratio(counts).scalar()
    stats = corpus_statistics(counted, counts)
    return stats.select(
        "n_labels",
        ratio.alias("imbalance_ratio"),
        "min_words",
        "max_words",
        "avg_words",
        "avg_paragraphs",
        "n_docs",
        "total_paragraphs",
    )
