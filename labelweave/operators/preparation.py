"""From a labelled corpus to train, validation and test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.text import unit_hash, word_count
from labelweave.operators.documents import MIN_WORDS
from labelweave.operators.labels import label_counts
from labelweave.plans.durable import stored
from labelweave.plans.sizing import as_array


def viable_labels(counts: DataFrame, min_count: int | None) -> DataFrame:
    """Labels with at least ``min_count`` documents; all of them for None."""
    return counts if min_count is None else counts.where(F.col("n") >= min_count)


def keep_viable(docs: DataFrame, counts: DataFrame, min_count: int | None) -> DataFrame:
    """Drop rare labels, then documents left without any.

    With ``None`` nothing is dropped, unlabelled documents included. Each
    distinct label list is cut once, by a join with the class table, and
    meets the documents again by that list; hand over narrow rows, as all
    columns of ``docs`` go through that join.
    """
    if min_count is None:
        return docs
    viable = viable_labels(counts, min_count).select("label")
    lists = docs.select("labels").distinct().select("labels", F.explode("labels").alias("label"))
    cut = lists.join(viable, "label", "left_semi").groupBy("labels").agg(F.sort_array(F.collect_set("label")).alias("kept"))
    joined = docs.join(cut, "labels")
    return joined.select(*[F.col("kept").alias("labels") if c == "labels" else F.col(c) for c in docs.columns])


def label_ids(counts: DataFrame) -> DataFrame:
    """(label_id, label), ids from 0 in alphabetical order; class-sized."""
    rank = F.row_number().over(Window.orderBy("label")) - 1
    return counts.select(rank.alias("label_id"), "label")


def encode(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, label_id): the ones of the 0/1 label matrix."""
    pairs = docs.select("doc_id", F.explode(F.array_distinct("labels")).alias("label"))
    return pairs.join(ids, "label").select("doc_id", "label_id")


def multi_hot(docs: DataFrame, label_table: DataFrame) -> DataFrame:
    """Add ``y``, the dense 0/1 row in class order."""
    names = as_array(label_table, "label")
    hot = F.transform("names", lambda l: F.array_contains(F.col("labels"), l).cast("int"))
    return docs.withColumn("names", names).withColumn("y", hot).drop("names")


def split_of(key: Column, test: float = 0.15, val: float = 0.15, seed: int = 42) -> Column:
    """train, val or test from a seeded hash of the key."""
    u = unit_hash(seed, key)
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def split(texts: DataFrame, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split``. Keyed by the text, so copies never straddle two parts."""
    return texts.withColumn("split", split_of(F.sha2("text", 256), test, val, seed))


def prepare_texts(
    texts: DataFrame, labelled: DataFrame | None = None, min_count: int | None = None, min_words: int = MIN_WORDS,
    test: float = 0.15, val: float = 0.15, seed: int = 42,
) -> DataFrame:
    """Texts with n_words and split, stored once by split; what training and testing start from.

    Given ``labelled`` (doc_id, labels), labels of fewer than ``min_count``
    documents go, then documents left without a label; all that comes before
    the split. Which documents stay is written first, as ids and labels, so
    that Spark knows its size and broadcasts it where it is small; the texts
    then stay in the tasks that read them. The text is worked out, measured
    and hashed in a single pass, and meets its labels in it; reading one split
    or counting documents then touches only what it needs. Documents below
    ``min_words`` stay in the files but not in the result.
    """
    if labelled is not None:
        kept = keep_viable(labelled.select("doc_id", "labels"), label_counts(labelled), min_count)
        texts = texts.join(stored(kept, "kept-documents"), "doc_id")
    measured = split(texts, test, val, seed).withColumn("n_words", F.coalesce(word_count(F.col("text")), F.lit(0)))
    return stored(measured, "texts", ["split"]).where(F.col("n_words") >= min_words)


def prepared_summary(split_docs: DataFrame, label_table: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Documents per split with the number of labels and features."""
    return split_docs.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs")).withColumns(
        {
            "n_labels": label_table.agg(F.count(F.lit(1))).scalar(),
            "n_features": vocabulary.agg(F.count(F.lit(1))).scalar(),
        }
    )


def label_balance(docs: DataFrame) -> DataFrame:
    """(label, n_pos, n_neg) over the documents given."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    return label_counts(docs).select(
        "label", F.col("n").alias("n_pos"), (n - F.col("n")).alias("n_neg")
    )


def class_weights(balance: DataFrame) -> DataFrame:
    """Weights that give both classes half the total; null for an empty one."""
    n = F.col("n_pos") + F.col("n_neg")
    share = lambda c: F.when(F.col(c) > 0, n / (2.0 * F.col(c)))
    return balance.select(
        "label", "n_pos", "n_neg", share("n_pos").alias("w_pos"), share("n_neg").alias("w_neg")
    )


def positive_weights(balance: DataFrame, low: float = 1.0, high: float = 50.0) -> DataFrame:
    """Negatives per positive, held between ``low`` and ``high``."""
    ratio = F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))
    weight = F.least(F.lit(high), F.greatest(F.lit(low), ratio))
    return balance.select("label", weight.alias("pos_weight"))
