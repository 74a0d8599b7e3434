"""TF-IDF features.

Fitting finds the terms that can belong to the vocabulary by mergeable
summaries and counts those exactly, so a few terms per task move. Where that
certifies nothing, each document's n-grams are written out once, sorted, and
one partially aggregated count by term gives both the corpus count and the
document frequency; a (document, term) pair never moves. Vectorizing
needs no shuffle at all: the vocabulary, cut to ``max_features``, is small by
construction and every document becomes a vector inside its own row.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path
from zipfile import ZipFile

from pyspark.find_spark_home import _find_spark_home
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.functions.text import ngrams, terms
from labelweave.functions.vectors import exploded
from labelweave.operators.heavyterms import certified
from labelweave.plans.durable import stored

# The limits of the feature space.
MAX_FEATURES = 10_000
MIN_DF = 2
MAX_DF = 0.95
NGRAM_RANGE = (1, 2)


def english_stop_words() -> list[str]:
    """Spark ML's English list; any other list can be passed instead.

    Read from Spark's own archive, so that no session is needed.
    """
    jars = Path(_find_spark_home()) / "jars"
    with ZipFile(next(jars.glob("spark-mllib_*.jar"))) as archive:
        return archive.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()


def with_terms(
    texts: DataFrame, stop_words: Sequence[str] | None = None, ngram_range: tuple[int, int] = NGRAM_RANGE
) -> DataFrame:
    """Replace ``text`` by ``terms``: n-grams over what the stop list (by default the English one) leaves."""
    stop_words = english_stop_words() if stop_words is None else stop_words
    tokens = texts.withColumn("tokens", terms(F.col("text"), stop_words)).drop("text")
    return tokens.withColumn("terms", ngrams(F.col("tokens"), *ngram_range)).drop("tokens")


def term_statistics(termed: DataFrame) -> DataFrame:
    """(term, tf, df) over the documents given, normally the train split."""
    ordered = termed.select(F.sort_array("terms").alias("terms"))
    flagged = F.transform(
        "terms",
        lambda t, i: F.struct(
            t.alias("term"),
            F.when((i > 0) & (F.get("terms", i - 1) == t), 0).otherwise(1).alias("first"),
        ),
    )
    return ordered.select(F.explode(flagged).alias("r")).groupBy(F.col("r.term").alias("term")).agg(
        F.count(F.lit(1)).alias("tf"), F.sum("r.first").alias("df")
    )


def vocabulary(
    statistics: DataFrame, n_docs: Column, min_df: int = MIN_DF, max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
) -> DataFrame:
    """(term_id, term, tf, df, idf), at most ``max_features`` rows.

    The document-frequency limits come first, then the most frequent terms
    (ties alphabetical); ids follow the alphabet.
    """
    n, df = F.col("n_docs"), F.col("df")
    within = statistics.withColumn("n_docs", n_docs).where((df >= min_df) & (df <= max_df * n))
    kept = within.orderBy(F.desc("tf"), "term").limit(max_features)
    idf = F.log((1.0 + n) / (1.0 + df)) + 1.0
    rows = kept.agg(F.sort_array(F.collect_list(F.struct("term", "tf", "df", idf.alias("idf")))).alias("rows"))
    return rows.select(F.posexplode("rows").alias("term_id", "r")).select("term_id", "r.*")


def fit_vocabulary(
    train: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES
) -> DataFrame:
    """The vocabulary of the train documents, computed once and stored.

    Only terms that can belong to it are counted and moved (``certified``);
    where the terms are too even for that, all are. It is read several times
    afterwards and has at most ``max_features`` rows, so what is stored is
    small. Counting the documents reads none of their text.
    """
    limits = {"min_df": min_df, "max_df": max_df, "max_features": max_features}
    n_docs = train.agg(F.count(F.lit(1))).scalar()
    found = certified(train, "terms", max_features, min_df, lambda counted: vocabulary(counted, n_docs, **limits))
    return stored(vocabulary(term_statistics(train), n_docs, **limits), "vocabulary") if found is None else found


def vectorize(termed: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace ``terms`` by ``features``, the L2-normalised TF-IDF vector.

    The vocabulary comes to the driver; ``vocabulary`` bounds its size.
    """
    rows = vocab.orderBy("term_id").collect()
    if not rows:
        raise ValueError("empty vocabulary: no term passes the frequency limits")
    counts = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in rows], inputCol="terms", outputCol="counts"
    )
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="counts", outputCol="weighted"
    )
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    return unit.transform(weighted.transform(counts.transform(termed))).drop("terms", "counts", "weighted")


def feature_rows(vectorized: DataFrame) -> DataFrame:
    """(doc_id, term_id, tfidf)"""
    return exploded(vectorized, "features", "doc_id").withColumnRenamed("value", "tfidf")


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
