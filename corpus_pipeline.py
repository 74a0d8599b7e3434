"""From raw documents to packed training sequences, stage by stage.

Every stage reads what the one before it wrote, in the shared folder that the
session names, so a lost executor costs work within one stage only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import grading, language, nearcopies, packing, secrets
from labelweave.plans.durable import run_dir

LEAST_LANGUAGE_SCORE = 0.3
LEAST_TAIL = 0.5
OWN = "_labelweave_"  # starts names that no table has
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 1_900_000  # with one more text mostly less than an encoder takes together
TEXTS_AT_ONCE = 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """``stage``, whose Python tasks get Arrow batches of at most about ``MOST_BATCH_BYTES``, or of one longer row.

    By rows alone a batch is a whole row group of texts, and the JVM and
    Python hold a few copies of it for each task. The stage's result is lazy,
    so the bound stays in the session; one that the session has already set
    is kept.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, MOST_BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those that are like none of the languages learned.

    Judged per row, a row without doc_id too; a table without any language
    to learn from loses nothing but texts without a letter.
    """
    model = language.fit(docs)
    judged = language.annotate(docs, model, (f"{OWN}lang", f"{OWN}score", f"{OWN}like"))
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    known = (F.col(f"{OWN}lang") != language.UNKNOWN) & (F.col(f"{OWN}score") >= LEAST_LANGUAGE_SCORE) & F.col(f"{OWN}like")
    return judged.where(known if model is not None else has_letter).select(*docs.columns)


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the top grade is low; without ratings all stay."""
    rated = grading.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = grading.annotate(docs, grading.fit(docs, rated), (f"{OWN}grade", f"{OWN}tail"))
    return judged.where(F.coalesce(F.col(f"{OWN}tail") >= LEAST_TAIL, F.lit(True))).select(*docs.columns)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id.

    Near copies share 0.8 of their five-word shingles or more; no such pair is
    missed. Rows that share a doc_id are documents of their own.
    """
    return nearcopies.first_of_groups(docs).select(*docs.columns)


@small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; n_chars follows the new text. No row goes."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else clean


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1,024 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024, at_once=TEXTS_AT_ONCE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]

# Models and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents`` of ``sf_dir``, each written and read again."""
    folder = run_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
