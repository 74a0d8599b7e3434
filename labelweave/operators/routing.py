"""Long documents: measure, route, shorten once per distinct text, score."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.text import content_digest, content_key
from labelweave.functions.tokens import CLASSIFIER_SPECIALS, TOKEN, token_count, tokens
from labelweave.plans.durable import stored
from labelweave.sources.summaries import append_cache, read_cache

# The classifier's window, the share of a shortened text taken
# from its start, the mark between the two parts, and rows per model call.
MAX_LENGTH = 4096
HEAD_RATIO = 0.7
GAP = " [...] "
BATCH_SIZE = 8

# Scored cells that a task puts together at once.
CELLS_TOGETHER = 1 << 20

Strategy = Callable[[DataFrame], DataFrame]


def analyze_lengths(texts: DataFrame, max_length: int = MAX_LENGTH, count: Column | None = None) -> DataFrame:
    """(doc_id, token_count, exceeds_limit, route)"""
    counted = texts.select("doc_id", (token_count(F.col("text")) if count is None else count).alias("token_count"))
    exceeds = F.col("token_count") > max_length
    # The words for the two routes.
    return counted.withColumns(
        {"exceeds_limit": exceeds, "route": F.when(exceeds, "summarize").otherwise("direct")}
    )


def length_statistics(lengths: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Routes and token counts in one row, from one row per distinct length."""
    by_length = lengths.groupBy("token_count").agg(F.count(F.lit(1)).alias("n"))
    t, n = F.col("token_count"), F.col("n")
    direct = F.sum(F.when(t <= max_length, n).otherwise(0))
    long = F.sum(F.when(t > max_length, n).otherwise(0))
    return by_length.agg(
        F.sum(n).alias("total_docs"), direct.alias("direct_route"), long.alias("summarize_route"),
        (direct * 100.0 / F.sum(n)).alias("direct_pct"), (long * 100.0 / F.sum(n)).alias("summarize_pct"),
        (F.sum(t * n) / F.sum(n)).alias("token_mean"),
        F.percentile(t, F.lit(0.5), n).alias("token_median"),
        F.max(t).alias("token_max"),
    ).withColumn("max_length_threshold", F.lit(max_length).cast("bigint"))


def route_counts(lengths: DataFrame) -> DataFrame:
    """(route, n_docs) of one run; append them to a table to add runs up."""
    return lengths.groupBy("route").agg(F.count(F.lit(1)).alias("n_docs"))


def append_run(counts: DataFrame, path: str, run: str) -> None:
    counts.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def processing_totals(runs: DataFrame) -> DataFrame:
    on = lambda name: F.sum(F.when(F.col("route") == name, F.col("n_docs")).otherwise(0))
    return runs.agg(
        F.sum("n_docs").alias("total_processed"),
        on("direct").alias("direct_classified"),
        on("summarize").alias("summarized_first"),
    )


def truncated(text: Column, max_length: int = MAX_LENGTH, specials: int = CLASSIFIER_SPECIALS) -> Column:
    """The text up to the end of the last token that fits the window, otherwise as it is."""
    keep = max_length - specials
    found, between = tokens(text), F.split(text, TOKEN)
    sizes = F.zip_with(
        F.slice(between, 1, keep), F.slice(found, 1, keep), lambda gap, token: F.length(gap) + F.length(token)
    )
    end = F.aggregate(sizes, F.lit(0), lambda total, size: total + size)
    return F.when(F.size(found) <= keep, text).otherwise(F.substring(text, F.lit(1), end))


def head_tail(text: Column, n_tokens: Column, max_length: int = MAX_LENGTH, head_ratio: float = HEAD_RATIO) -> Column:
    """Start and end of a text, cut to the share of characters that fits."""
    target = F.floor(F.length(text).cast("bigint") * max_length / n_tokens).cast("int")
    head = F.floor(target * F.lit(head_ratio)).cast("int")
    return F.concat(F.substring(text, F.lit(1), head), F.lit(GAP), F.right(text, target - head))


def truncate_strategy(max_length: int = MAX_LENGTH) -> Strategy:
    return lambda long: long.withColumn("summary", truncated(F.col("text"), max_length))


def head_tail_strategy(max_length: int = MAX_LENGTH, head_ratio: float = HEAD_RATIO) -> Strategy:
    shorten = lambda: head_tail(F.col("text"), F.col("token_count"), max_length, head_ratio)
    return lambda long: long.withColumn("summary", shorten())


def model_strategy(load: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = BATCH_SIZE) -> Strategy:
    """Summaries from a Python model, loaded once per task.

    ``load()`` returns a function from up to ``batch_size`` texts to as many
    summaries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        summarize = load()
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for start in range(0, len(texts), batch_size):
                out.extend(summarize(texts[start : start + batch_size]))
            yield batch.assign(summary=out)

    def apply(long: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema.fields)
        return long.mapInPandas(run, f"{fields}, summary string")

    return apply


def is_long(max_length: int = MAX_LENGTH) -> Column:
    """Whether ``text`` exceeds the window; a null text doesn't.

    No text has more tokens than characters, so most short texts are decided
    by their length alone.
    """
    roomy = F.length("text") + CLASSIFIER_SPECIALS <= max_length
    return F.coalesce(~roomy & (token_count(F.col("text")) > max_length), F.lit(False))


def content_keys(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, hash, original_length, token_count): all but the text."""
    return texts.select(
        "doc_id",
        content_digest(F.col("text")).alias("digest"),
        content_key(F.col("text")).alias("hash"),
        F.length("text").cast("bigint").alias("original_length"),
        token_count(F.col("text")).alias("token_count"),
    )


def cache_hits(keys: DataFrame, cache: DataFrame) -> DataFrame:
    return keys.join(cache, "digest", "left_semi")


def cache_misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """(digest, hash, original_length, token_count), one row per unknown text.

    Grouped before the cache is looked up: a text with millions of copies is
    one row from there on.
    """
    one_each = keys.groupBy("digest").agg(
        F.min("hash").alias("hash"), F.min("original_length").alias("original_length"), F.max("token_count").alias("token_count")
    )
    return one_each.join(cache, "digest", "left_anti")


def _summarized(texts: DataFrame, missing: DataFrame, strategy: Strategy) -> DataFrame:
    """Cache entries for the texts of ``missing``, each found by its digest and summarized once."""
    keyed = texts.select(content_digest(F.col("text")).alias("digest"), "text")
    one_each = keyed.join(missing.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    return strategy(one_each.join(missing, "digest")).select(
        "digest", "hash", "original_length", F.length("summary").cast("bigint").alias("summary_length"), "summary"
    )


def summarize_corpus(texts: DataFrame, cache_path: str | None, strategy: Strategy) -> DataFrame:
    """(doc_id, summary, cached) for every document given.

    Texts are told apart by their whole digest, never by doc_id, which may
    repeat. Each distinct unknown text is summarized once and stored, so a
    failed or repeated run pays only for what is not in the cache yet.
    Without a ``cache_path`` every distinct text is summarized and nothing is
    kept. A null text has a null summary.
    """
    spark = texts.sparkSession
    keys = stored(content_keys(texts), "content-keys")
    if cache_path is None:
        entries = stored(_summarized(texts, cache_misses(keys.where("digest is not null"), keys.limit(0)), strategy), "summaries")
        entries = entries.withColumn("cached", F.lit(False))
    else:
        # The files seen here are those of earlier runs, also after the append.
        known = read_cache(spark, cache_path, keys).select("digest", F.lit(True).alias("cached"))
        missing = stored(cache_misses(keys.where("digest is not null"), known), "cache-misses")
        append_cache(_summarized(texts, missing, strategy), cache_path)
        entries = read_cache(spark, cache_path, keys).join(known, "digest", "left")
    found = entries.select("digest", "summary", F.coalesce("cached", F.lit(False)).alias("cached"))
    return keys.select("doc_id", "digest").join(found, "digest", "left").select(
        "doc_id", "summary", F.coalesce("cached", F.lit(False)).alias("cached")
    )


def preprocess(texts: DataFrame, cache_path: str | None, strategy: Strategy, max_length: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, text): long texts replaced by their summary, others as is.

    Short and null texts pass through without a shuffle.
    """
    texts = texts.select("doc_id", "text")
    long = summarize_corpus(texts.where(is_long(max_length)), cache_path, strategy)
    return texts.where(~is_long(max_length)).unionAll(long.select("doc_id", F.col("summary").alias("text")))


def score_batches(
    texts: DataFrame, load: Callable[[], Callable[[list[str]], "Sequence[Sequence[float]]"]],
    labels: Sequence[str], batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """(doc_id, cells): a struct (label, p) per label from a Python model.

    ``load()`` runs once per task and returns a function from up to
    ``batch_size`` texts to one row of probabilities each, in the order of
    ``labels``. Names meet probabilities by position, batch by batch.
    """
    names, rows_together = list(labels), max(1, CELLS_TOGETHER // max(1, len(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        known = pa.array(names, pa.string())
        for whole in batches:
            for first in range(0, whole.num_rows, rows_together):
                batch = whole.slice(first, rows_together)
                texts, n, k = batch.column("text").to_pylist(), batch.num_rows, len(names)
                found = np.empty((n, k))
                for start in range(0, n, batch_size):
                    some = texts[start : start + batch_size]
                    found[start : start + batch_size] = np.asarray(score(some), dtype=np.float64).reshape(len(some), k)
                cell = [known.take(pa.array(np.tile(np.arange(k), n))), pa.array(found.ravel())]
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * k, pa.int32())
                cells = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(cell, names=["label", "p"]))
                yield pa.record_batch([batch.column("doc_id"), cells], names=["doc_id", "cells"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, cells array<struct<label:string,p:double>>")
