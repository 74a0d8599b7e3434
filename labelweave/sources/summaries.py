"""The summary cache: one row per distinct text, keyed by content."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The layout of a cache entry as it is exchanged.
CACHE_SCHEMA = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("original_length", T.LongType()),
        T.StructField("summary_length", T.LongType()),
        T.StructField("summary", T.StringType()),
    ]
)


def import_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Entries kept as JSON, one document per file or one per line."""
    return spark.read.schema(CACHE_SCHEMA).option("multiLine", one_per_file).json(path)


def export_json(entries: DataFrame, path: str) -> None:
    """One entry per line."""
    entries.select(*CACHE_SCHEMA.names).write.mode("overwrite").json(path)


# The stored cache tells texts apart by the whole digest of the text.
STORED_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), *CACHE_SCHEMA.fields])


def read_cache(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The stored cache, one row per text, empty where nothing has been stored yet.

    Two runs may have stored the same text; one of their summaries is used.
    Entries that were imported have no digest. Given ``keys`` (digest, hash,
    original_length), they take that of the text with their key and length.
    """
    try:
        stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], STORED_SCHEMA)
    if keys is not None:
        texts = keys.where("digest is not null").groupBy("hash", "original_length").agg(F.min("digest").alias("own"))
        bare = stored.where("digest is null").join(texts, ["hash", "original_length"])
        stored = stored.where("digest is not null").unionByName(bare.withColumn("digest", F.col("own")).select(*STORED_SCHEMA.names))
    one_each = stored.groupBy("digest", "hash", "original_length").agg(F.min("summary").alias("summary"))
    return one_each.withColumn("summary_length", F.length("summary").cast("bigint")).select(*STORED_SCHEMA.names)


def append_cache(entries: DataFrame, path: str) -> None:
    """Add entries; those without a ``digest`` column are stored without one."""
    if "digest" not in entries.columns:
        entries = entries.withColumn("digest", F.lit(None).cast("binary"))
    entries.select(*STORED_SCHEMA.names).write.mode("append").parquet(path)


def cache_statistics(cache: DataFrame) -> DataFrame:
    """Entries, characters before and after, and entries whose length is off."""
    return cache.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum("original_length").alias("original_chars"),
        F.sum("summary_length").alias("summary_chars"),
        F.count_if(F.length("summary") != F.col("summary_length")).alias("n_wrong_length"),
    )
