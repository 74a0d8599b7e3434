"""Per-document projections and filters over the nested corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions import nested
from labelweave.functions.text import word_count

MIN_WORDS = 10


def with_text(docs: DataFrame, col: str = "sections", fallback_text: bool = True) -> DataFrame:
    """Add the flattened ``text``."""
    return docs.withColumn("text", nested.extract_text(docs, col, fallback_text))


def with_counts(docs: DataFrame, col: str = "sections") -> DataFrame:
    """Add n_words, n_paragraphs and n_sections; the sections go no further."""
    kept = [c for c in docs.columns if c != col]
    return docs.select(
        *kept,
        nested.document_words(docs, col).alias("n_words"),
        nested.paragraph_count(docs, col).alias("n_paragraphs"),
        nested.section_count(docs, col).alias("n_sections"),
    )


def split_by_length(texts: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by the word count of ``text``; a null text has no words."""
    counted = texts.withColumn("n_words", F.coalesce(word_count(F.col("text")), F.lit(0)))
    return counted.where(F.col("n_words") >= min_words), counted.where(F.col("n_words") < min_words)


def minimal_text(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Ids of documents with fewer than ``min_words`` words."""
    return docs.where(nested.document_words(docs) < min_words).select("doc_id")


def preview(docs: DataFrame, n: int = 3, chars: int = 200) -> DataFrame:
    """The start of the first paragraph of the first section, first n ids."""
    first = F.try_element_at(F.try_element_at("sections", F.lit(1))["paragraphs"], F.lit(1))
    return docs.orderBy("doc_id").limit(n).select(
        "doc_id",
        nested.section_count(docs).alias("n_sections"),
        F.substring(first, 1, chars).alias("preview"),
    )
