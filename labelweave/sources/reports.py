"""The label-distribution report as one nested JSON row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.operators.labels import taxonomy_summary, with_tier


def label_report(counts: DataFrame, min_samples: int = 50) -> DataFrame:
    """Summary, labels per tier, the modelling subset and all counts.

    One row that holds every class, as large as the label table.
    """
    tiers = with_tier(counts)
    item = F.struct((-F.col("n")).alias("o"), F.col("label"), F.col("n"))

    def listed(condition: Column | None = None) -> Column:
        picked = item if condition is None else F.when(condition, item)
        return F.sort_array(F.collect_list(picked))

    names = lambda rows: F.transform(rows, lambda r: r["label"])
    in_tier = lambda name: names(listed(F.col("tier") == name)).alias(name)
    lists = tiers.agg(
        F.struct(in_tier("common"), in_tier("moderate"), in_tier("rare")).alias("tiers"),
        names(listed(F.col("n") >= min_samples)).alias("modeling_subset"),
        F.transform(listed(), lambda r: F.struct(r["label"].alias("label"), r["n"].alias("n"))).alias(
            "full_distribution"
        ),
    )
    summary = taxonomy_summary(counts)
    return lists.withColumn("summary", summary.select(F.struct(*summary.columns)).scalar())


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
