"""Document fingerprints of closed syncmers, in built-in column expressions only.

The text is a sequence of lower-case words. A run of ``k`` words is an anchor
when the smallest of its inner runs of ``s`` words, by hash, is its first or
its last. Whether a run is an anchor depends on its own words alone, so texts
that share a passage share its anchors, wherever it stands.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.plans.durable import stored

K, S = 5, 1
ROWS_PER_BUCKET = 2000
MAX_BUCKETS = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """Anchors as array<struct<pos int, hash bigint>> in text order.

    hash is xxhash64 of the run's words joined by blanks. A text of fewer
    words than ``k``, or without an anchor, has its whole sequence as the
    only anchor; a text without words has none.
    """
    last = k - s

    def inner(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ws) - s),
            lambda i: F.xxhash64(F.get(ws, i) if s == 1 else F.concat_ws(" ", F.slice(ws, i + 1, F.lit(s)))),
        )

    def is_anchor(h: Column, i: Column) -> Column:
        edges = F.least(F.get(h, i), F.get(h, i + last))
        return F.least(*[F.get(h, i + j) for j in range(last + 1)]) == edges

    def chosen(ws: Column) -> Column:
        runs = F.sequence(F.lit(0), F.size(ws) - k)
        return let(
            let(inner(ws), lambda h: F.filter(runs, lambda i: is_anchor(h, i))),
            lambda at: F.transform(
                at,
                lambda i: F.struct(
                    i.alias("pos"), F.xxhash64(F.concat_ws(" ", F.slice(ws, i + 1, F.lit(k)))).alias("hash")
                ),
            ),
        )

    def whole(ws: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.concat_ws(" ", ws)).alias("hash")))

    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return let(
        words(F.coalesce(text, F.lit(""))),
        lambda ws: F.when(F.size(ws) == 0, none)
        .when(F.size(ws) < k, whole(ws))
        .otherwise(let(chosen(ws), lambda found: F.when(F.size(found) > 0, found).otherwise(whole(ws)))),
    )


def hashes(anchors: Column) -> Column:
    return F.array_distinct(F.transform(anchors, lambda a: a["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 when both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def printed(distinct: Column) -> Column:
    """The upper halves of the hashes in text order, in hexadecimal."""
    return F.array_join(F.transform(distinct, lambda h: F.lower(F.hex(F.shiftrightunsigned(h, 32)))), ",")


def _bucket(bounds: Column, value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MAX_BUCKETS.bit_length()))])

    def step(reached: Column, by: Column) -> Column:
        ahead = (reached + by <= F.size(bounds)) & (F.get(bounds, reached + by - 1) <= value)
        return F.when(ahead, reached + by).otherwise(reached)

    return F.when(value.isNull() | bounds.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), step))


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``prepare(docs)`` with next_<column> of the following row by descending doc_id, the first after the last.

    ``docs`` (doc_id, text) is cut at quantiles of doc_id into buckets of
    about 2,000 rows (at most 10,000 buckets). Each bucket's first row is
    also sent, as a guest, to the bucket before it, so every row finds its
    successor in its own bucket and the text is shuffled once. Equal doc_ids
    follow each other by text; null doc_ids come last.
    """
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, math.ceil(n / ROWS_PER_BUCKET)))
    cuts = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = docs.agg(F.sort_array(F.array_distinct(F.percentile_approx("doc_id", cuts, MAX_BUCKETS))).alias("b")).scalar()
    placed = docs.withColumn("bounds", bounds).select(*docs.columns, _bucket(F.col("bounds"), F.col("doc_id")).alias("bucket"))
    # One row per bucket, so neither this window nor the broadcast grows beyond their number.
    order = Window.orderBy(F.desc("bucket"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    firsts = firsts.select(
        F.col("bucket").alias("own"), "first_id",
        F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(everything)).alias("visits"),
    )
    firsts = F.broadcast(stored(firsts, "first-of-bucket"))
    is_first = (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    at_home = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    as_guest = F.struct(F.col("visits").alias("bucket"), F.lit(True).alias("guest"))
    dealt = (
        placed.join(firsts, is_first, "left")
        .select(*docs.columns, F.explode(F.when(F.col("visits").isNull(), F.array(at_home)).otherwise(F.array(at_home, as_guest))).alias("p"))
        .select(*docs.columns, "p.bucket", "p.guest")
        .repartition("bucket")
    )
    following = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    ready = prepare(dealt)
    return ready.select("*", *[F.lead(c).over(following).alias(f"next_{c}") for c in columns]).where(~F.col("guest"))


def compare_with_edit(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next document's. A null text is empty; an empty
    text has an empty fingerprint; two empty fingerprints are alike by 1. A
    single row is its own next; repeated rows follow each other; an empty
    table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    marked = with_next(docs, lambda d: d.withColumn("marks", hashes(syncmers(F.col("text"), k, s))), ["text", "marks"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    both = (
        marked.withColumn("n_chars", F.char_length("text").cast("bigint"))
        .withColumn("edited", edited)
        .withColumn("edited_marks", hashes(syncmers(F.col("edited"), k, s)))
    )
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("marks")).alias("fingerprint"), printed(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
