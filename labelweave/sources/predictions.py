"""Stored predictions, one partition per model and split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_all(scored: DataFrame, path: str) -> None:
    """Store (doc_id, cells, y_pred, model, split) of any number of models and splits in one write.

    The partitions that ``scored`` has rows for are replaced, others stay.
    """
    scored.select("doc_id", "cells", "y_pred", "model", "split").write.partitionBy("model", "split").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").parquet(path)


def save_predictions(scored: DataFrame, path: str, model: str, split: str) -> None:
    """Store (doc_id, cells, y_pred) under its model and split; saving again replaces that part only."""
    save_all(scored.withColumns({"model": F.lit(model), "split": F.lit(split)}), path)


def load_predictions(
    spark: SparkSession, path: str, model: str | None = None, split: str | None = None
) -> DataFrame:
    stored = spark.read.parquet(path)
    if model is not None:
        stored = stored.where(F.col("model") == model)
    if split is not None:
        stored = stored.where(F.col("split") == split)
    return stored


def stored_or_scored(
    spark: SparkSession, path: str, model: str, split: str, score: Callable[[], DataFrame]
) -> DataFrame:
    """Stored predictions if there are any, otherwise score, store and read back.

    A part appears with its write's commit, so one cut short by a failure is
    scored again.
    """
    try:
        if not load_predictions(spark, path, model, split).isEmpty():
            return load_predictions(spark, path, model, split)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    save_predictions(score(), path, model, split)
    return load_predictions(spark, path, model, split)
