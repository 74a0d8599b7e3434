"""Corpora derived from the base tables, used by the registered queries.

Each builder reads only the tables its columns need: label-only work never
scans text and text-only work never joins the label table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.labels import label_counts
from labelweave.operators.preparation import split_of
from labelweave.plans.sizing import as_array


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels() -> Column:
    doc = F.col("doc_id")
    return F.array_compact(
        F.array(
            F.when(doc % 20 != 0, F.concat(F.lit("lang:"), "lang")),
            F.when(doc % 2 == 1, F.concat(F.lit("src:"), "source")),
            F.when(F.col("quality") == 1, F.lit("q:hi")),
            F.when(F.col("quality") == 0, F.lit("q:lo")),
            F.when(F.col("toxic") == 1, F.lit("toxic")),
            F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("q:lo:toxic")),
            F.when(doc % 50 == 7, F.concat(F.lit("rare:"), F.expr("cast((doc_id div 50) % 9 as string)"))),
        )
    )


def _sections() -> Column:
    """One section per line, one paragraph per sentence."""
    return F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(F.lit("").alias("headtext"), F.split(line, r"\. ").alias("paragraphs")),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, labels)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    marks = table(spark, sf_dir, "labels")
    return docs.join(marks, "doc_id", "left").select("doc_id", _labels().alias("labels"))


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sections)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", _sections().alias("sections"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, labels, sections)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    marks = table(spark, sf_dir, "labels")
    return docs.join(marks, "doc_id", "left").select(
        "doc_id", _labels().alias("labels"), _sections().alias("sections")
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, labels): the part brands of each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(F.sort_array(F.collect_set("p_brand")).alias("labels"))
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label), which may repeat: the parts of each order, and one document with all parts and orders.

    A row each, as no row can hold all parts and orders of a large store.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p:"), "l_partkey").alias("label"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("label"))
    every = lines.select("label").unionByName(orders).distinct().select(F.lit(-1).cast("bigint").alias("doc_id"), "label")
    return lines.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label").unionByName(every)


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, labels): the part and order of each line, in parts by line number."""
    names = [F.concat(F.lit("p:"), "l_partkey"), F.concat(F.lit("o:"), "l_orderkey")]
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("part"), F.array(*names).alias("labels"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, split, y_true, cells): truth and two models' probabilities.

    ``cells`` holds one struct (label, p1, p2) per class in class order, as a
    model returns one value per class. Probabilities are whole thousandths.
    """
    docs = labelled(spark, sf_dir)
    classes = as_array(label_counts(docs), "label")
    doc = F.col("doc_id")

    def cell(label: Column, idx: Column) -> Column:
        y = F.array_contains(F.col("y_true"), label)
        h1 = (doc * 7919 + idx * 104729) % 1000
        h2 = (doc * 6421 + idx * 15485) % 1000
        p1 = F.when(y, 350 + F.floor(h1 * 65 / 100)).otherwise(F.floor(h1 * 75 / 100))
        p2 = F.when(y, 250 + F.floor(h2 * 75 / 100)).otherwise(F.floor(h2 * 70 / 100))
        return F.struct(label.alias("label"), p1.cast("int").alias("p1"), p2.cast("int").alias("p2"))

    return (
        docs.select("doc_id", F.col("labels").alias("y_true"), classes.alias("classes"))
        .select("doc_id", "y_true", F.transform("classes", cell).alias("cells"))
        .withColumn("split", split_of(F.col("doc_id").cast("string")))
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label): the evaluated classes."""
    return label_counts(labelled(spark, sf_dir)).select("label")
