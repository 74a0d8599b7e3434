"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.plans.durable import discard, stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Each ``a`` with the smallest node among itself and its neighbours, as a table.

    Written, so that the join on ``a`` has plain shuffles on both sides and a
    node with very many edges is split by the skew join.
    """
    return stored(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "star-lows")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    lows = _lowest(edges)
    joined = edges.join(lows, "a")
    if large:
        pairs = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        both = F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        pairs = joined.select(both.alias("e")).select("e.a", "e.b")
    out = stored(pairs.where("a > b").distinct(), "star-edges")
    discard(lows)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is its smallest node.

    Alternates large-star and small-star steps until the edges stay the same,
    which takes a number of rounds that grows with the logarithm of the
    longest path. Each round writes its edges to the shared folder, so a lost
    executor costs one round at most, and nothing but two numbers a round
    reaches the driver. Self-loops and repeated edges are allowed; nodes are
    integers and not null.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.select(high.alias("a"), low.alias("b")).where("a > b").distinct(), "star-edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        wide = _star(both, large=True)
        after = _star(wide, large=False)
        discard(wide)
        discard(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )
