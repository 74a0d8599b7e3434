"""Which labels occur together, and which imply which.

Everything starts from ``label_sets`` (one row per distinct sorted label list
with its document count), so pairs are formed once per distinct list and not
once per document, and popular lists cost one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from labelweave.plans.durable import stored
from labelweave.plans.sizing import as_array

# How many labels of a list are paired at a time with as many others.
BLOCK = 256

# How many sorted names at most meet one another, a divisor of 2 ** 33.
RUN = 256

# In how many groups the pieces of a long list meet one another.
GROUPS = 64

# How many lists at most are looked up by label instead of being paired.
LOOKED_UP = 32


def set_label_counts(sets: DataFrame) -> DataFrame:
    """(label, n) from distinct label lists."""
    return sets.select(F.explode("labels").alias("label"), "n_docs").groupBy("label").agg(
        F.sum("n_docs").alias("n")
    )


def _cells(sets: DataFrame, block: int) -> DataFrame:
    """(left, right, n_docs): every two blocks of each list, dealt over tasks; right is null for a block with itself."""
    start = F.sequence(F.lit(0), F.greatest(F.size("labels") - 1, F.lit(0)), F.lit(block))
    blocks = F.transform(start, lambda i: F.slice("labels", i + 1, F.lit(block)))
    rows = sets.where(F.size("labels") > 1).select(F.xxhash64("labels").alias("list"), blocks.alias("blocks"), "n_docs")
    left = rows.select("list", "blocks", "n_docs", F.posexplode("blocks").alias("i", "left"))
    others = F.concat(F.array(F.lit(None).cast("array<string>")), F.slice("blocks", F.col("i") + 2, F.size("blocks")))
    cells = left.select("list", "i", "left", "n_docs", F.posexplode(others).alias("j", "right"))
    # With a number given, adaptive execution doesn't merge the parts again.
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "list", "i", "j").select("left", "right", "n_docs")


def _across(sets: DataFrame) -> DataFrame:
    """(a, b, n_docs): pairs of labels in two pieces of a list, dealt over tasks by groups of pieces."""
    pieces = sets.where("list is not null and size(labels) > 0").withColumn("row", F.xxhash64("labels"))
    placed = pieces.withColumn("g", F.pmod("row", F.lit(GROUPS)).cast("int"))
    met = placed.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))).select(
        "list", F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high"), "g", F.col("labels")[0].alias("first"), "labels", "n_docs"
    )
    left, right = (met.select("list", "low", "high", *[F.col(c).alias(f"{c}_{x}") for c in ("g", "first", "labels")], *n) for x, n in (("l", ["n_docs"]), ("r", [])))
    # Pieces have no label in common, so their first ones put them in order.
    inside = (F.least("g_l", "g_r") == F.col("low")) & (F.greatest("g_l", "g_r") == F.col("high")) & (F.col("first_l") < F.col("first_r"))
    heads = left.join(right, ["list", "low", "high"]).where(inside).select(F.explode("labels_l").alias("x"), "labels_r", "n_docs")
    both = heads.select("x", F.explode("labels_r").alias("y"), "n_docs")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n_docs")


def pair_counts(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, n) with a before b: documents that carry both labels.

    A list is cut into blocks of ``block`` labels and paired block by block,
    so the pairs of one long list are formed by many tasks. Rows with the same
    number in ``list`` are pieces of one list.
    """
    heads = _cells(sets, block).select(F.posexplode("left").alias("p", "a"), "left", "right", "n_docs")
    rest = F.coalesce("right", F.slice("left", F.col("p") + 2, F.size("left")))
    pairs = heads.select("a", F.explode(rest).alias("b"), "n_docs")
    if "list" in sets.columns:
        pairs = pairs.unionByName(_across(sets))
    return pairs.groupBy("a", "b").agg(F.sum("n_docs").alias("n"))


def supported(sets: DataFrame, keep: DataFrame) -> DataFrame:
    """The lists without labels that are not in ``keep`` (label); lists that become alike are one row, pieces of lists stay apart."""
    piece = [c for c in ("list",) if c in sets.columns]
    # A number is made once per row; an expression of the list would be worked out again for each of its labels.
    numbered = sets.withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("row", F.explode("labels").alias("label"), "n_docs", *piece)
    left = rows.join(keep.select("label"), "label", "left_semi").groupBy("row").agg(
        F.sort_array(F.collect_list("label")).alias("labels"), F.min("n_docs").alias("n_docs"), *[F.min(c).alias(c) for c in piece]
    )
    return left.groupBy("labels", *piece).agg(F.sum("n_docs").alias("n_docs"))


def _looked_up(lists: DataFrame, least: int, block: int) -> tuple[list[int], int]:
    """Ids and documents of the longest lists that have fewer than ``least`` documents together.

    A pair that only they hold can't reach the support. Lists of a block or
    less and lists that repeat a label are paired like any other; pieces of a
    list repeat none.
    """
    whole = (F.size("labels") > block) & (F.col("n_docs") < least) & (F.size(F.array_distinct("labels")) == F.size("labels"))
    sizes = lists.where(F.col("list").isNotNull() | whole).groupBy("id").agg(F.sum(F.size("labels")).alias("size"), F.max("n_docs").alias("n_docs"))
    ranked = sizes.where((F.col("size") > block) & (F.col("n_docs") < least)).orderBy(F.desc("size"), "n_docs", "id")
    ids, docs = [], 0
    for row in ranked.limit(min(LOOKED_UP, max(0, least - 1))).collect():
        if docs + row["n_docs"] < least:
            ids.append(row["id"])
            docs += row["n_docs"]
    return ids, docs


def frequent_pairs(sets: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(a, b, n) of the pairs in at least ``least`` documents, counted exactly.

    No pair is more frequent than its rarer label, so labels below ``least``
    go before any pair is formed. Nor is a pair frequent that occurs in a few
    lists only which have fewer than ``least`` documents together: the longest
    such lists form no pairs, and the pairs of the others that can reach the
    support look up how many of them hold both labels. Long lists may come in
    pieces (``label_sets``).
    """
    sets = stored(sets, "label-sets")
    keep = set_label_counts(sets).where(F.col("n") >= least)
    lists = supported(sets, keep)
    if "list" not in lists.columns:
        lists = lists.withColumn("list", F.lit(None).cast("bigint"))
    # Numbers of cut lists are below zero, those of others not.
    lists = stored(lists.withColumn("id", F.coalesce(-1 - F.col("list"), F.monotonically_increasing_id())), "supported-lists")
    ids, docs = _looked_up(lists, least, block)
    rest = lists.where(~F.col("id").isin(ids)) if ids else lists
    near = pair_counts(rest.drop("list") if rest.where("list is not null").isEmpty() else rest, block).where(F.col("n") >= least - docs)
    if not ids:
        return near
    held = lists.where(F.col("id").isin(ids)).select(F.explode("labels").alias("label"), F.struct("id", "n_docs").alias("held"))
    held = stored(held.groupBy("label").agg(F.collect_list("held").alias("held")), "looked-up")
    first, second = (held.select(F.col("label").alias(x), F.col("held").alias(f"in_{x}")) for x in "ab")
    # Only a list that repeats a label pairs it with itself.
    both = F.coalesce(F.when(F.col("a") != F.col("b"), F.array_intersect("in_a", "in_b")), F.array().cast("array<struct<id:bigint,n_docs:bigint>>"))
    n = F.col("n") + F.aggregate(both, F.lit(0).cast("bigint"), lambda total, one: total + one["n_docs"])
    return near.join(first, "a", "left").join(second, "b", "left").select("a", "b", n.alias("n")).where(F.col("n") >= least)


def top_pairs(pairs: DataFrame, k: int = 20) -> DataFrame:
    return pairs.orderBy(F.desc("n"), "a", "b").limit(k)


def both_directions(pairs: DataFrame) -> DataFrame:
    """(given, other, n): every pair once from each side."""
    sides = F.array(
        F.struct(F.col("a").alias("given"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("given"), F.col("a").alias("other")),
    )
    return pairs.select(F.explode(sides).alias("s"), "n").select("s.given", "s.other", "n")


def with_conditionals(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Add n_a, n_b and both conditional probabilities."""
    first = counts.select(F.col("label").alias("a"), F.col("n").alias("n_a"))
    second = counts.select(F.col("label").alias("b"), F.col("n").alias("n_b"))
    return pairs.join(first, "a").join(second, "b").select(
        "a", "b", "n", "n_a", "n_b",
        (F.col("n") / F.col("n_a")).alias("p_b_given_a"),
        (F.col("n") / F.col("n_b")).alias("p_a_given_b"),
    )


def directed_conditionals(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(given, other, n_given, n, p) for both directions of every pair."""
    totals = counts.select(F.col("label").alias("given"), F.col("n").alias("n_given"))
    return both_directions(pairs).join(totals, "given").select(
        "given", "other", "n_given", "n", (F.col("n") / F.col("n_given")).alias("p")
    )


def high_conditionals(
    directed: DataFrame, min_count: int = 10, min_p: float = 0.8, k: int = 30
) -> DataFrame:
    strong = directed.where((F.col("n_given") >= min_count) & (F.col("p") > min_p))
    return strong.orderBy(F.desc("p"), "given", "other").limit(k)


def strong_conditionals(sets: DataFrame, min_count: int = 10, min_p: float = 0.8, k: int = 30) -> DataFrame:
    """``high_conditionals`` from the label lists; only pairs that can reach both limits are counted."""
    sets = stored(sets, "label-sets")
    # A little below the product, which may be rounded up.
    least = max(1, math.floor(min_count * min_p * (1 - 1e-9)))
    directed = directed_conditionals(frequent_pairs(sets, least), set_label_counts(sets))
    return high_conditionals(directed, min_count, min_p, k)


def rare_dependencies(
    pairs: DataFrame, counts: DataFrame, rare_below: int = 50, common_from: int = 100,
    keep: int = 3, min_ratio: float = 0.8,
) -> DataFrame:
    """Rare labels that mostly come with one of their top common companions."""
    directed = directed_conditionals(pairs, counts)
    common = counts.where(F.col("n") >= common_from).select(F.col("label").alias("other"))
    candidates = directed.where(F.col("n_given") < rare_below).join(common, "other", "left_semi")
    rank = F.row_number().over(Window.partitionBy("given").orderBy(F.desc("n"), "other"))
    return (
        candidates.withColumn("rank", rank)
        .where((F.col("rank") <= keep) & (F.col("p") > min_ratio))
        .select("given", "other", "n", "n_given", "p")
    )


def prefix_pairs(counts: DataFrame, min_extra: int = 4, parts: int | None = None) -> DataFrame:
    """(short, long, n_short, n_long): names that start with another name, at least ``min_extra`` characters shorter.

    Names are sorted by ranges and cut into runs of at most ``RUN``; each
    meets those before it in its run. A name of an earlier run that starts any
    name of a run starts or equals its first one, so digests of what starts
    first names tell which names are met in further runs. Each name moves a
    fixed number of times and not once per character.
    """
    parts = parts or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.where("label is not null").select("label", "n").repartitionByRange(parts, "label").sortWithinPartitions("label")
    # The rows of each part are numbered in their order, from a multiple of 2 ** 33.
    placed = stored(ranged.select(F.monotonically_increasing_id().alias("place"), "label", "n"), "sorted-names")
    names = placed.withColumn("run", F.expr(f"place div {RUN}"))
    firsts = names.groupBy("run").agg(F.min("label").alias("first"))
    starts = firsts.select("run", "first", F.explode(F.sequence(F.lit(0), F.length("first"))).alias("size"))
    starts = starts.select(F.col("run").alias("later"), F.expr("xxhash64(substring(first, 1, size))").alias("digest"))
    carried = names.withColumn("digest", F.xxhash64("label")).join(starts, "digest").where("run < later")
    shorts = names.select("run", "place", "label", "n").union(carried.select("later", "place", "label", "n"))
    shorts = shorts.select("run", "place", F.col("label").alias("short"), F.col("n").alias("n_short"))
    longs = names.select("run", F.col("place").alias("at"), F.col("label").alias("long"), F.col("n").alias("n_long"))
    extra = F.length("long") - F.length("short")
    found = shorts.join(longs, "run").where(F.startswith("long", "short") & (F.col("place") < F.col("at")) & (extra >= min_extra))
    return found.select("short", "long", "n_short", "n_long")


def top_matrix(sets: DataFrame, counts: DataFrame, top_n: int = 15) -> DataFrame:
    """(a, b, n) for every ordered pair of the top labels, zeros included."""
    top = counts.orderBy(F.desc("n"), "label").limit(top_n)
    names = as_array(top, "label")
    inside = sets.withColumn("top", names).select(
        F.array_intersect("labels", "top").alias("labels"), "n_docs"
    )
    cells = top.select(F.col("label").alias("a"), names.alias("names")).select(
        "a", F.explode("names").alias("b")
    )
    found = both_directions(pair_counts(inside)).toDF("a", "b", "n")
    return cells.join(found, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pivoted(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """The matrix with one column per name; the names are the caller's."""
    return matrix.groupBy("a").pivot("b", list(names)).agg(F.sum("n"))


def rare_companionship(
    sets: DataFrame, counts: DataFrame, rare_below: int = 50, common_from: int = 100
) -> DataFrame:
    """Per rare label: never the only label, and always with a common one."""
    marks = counts.select("label", (F.col("n") >= common_from).cast("int").alias("common"))
    exploded = sets.select(F.explode("labels").alias("label"), F.size("labels").alias("k"), "labels").join(marks, "label")
    in_list = F.sum("common").over(Window.partitionBy("labels"))
    others = exploded.select("label", "k", (in_list - F.col("common")).alias("others"))
    per_label = others.groupBy("label").agg(
        F.min("k").alias("least"), F.every(F.col("others") > 0).alias("with_common")
    )
    rare = counts.where(F.col("n") < rare_below)
    never_alone = F.col("least") > 1
    return rare.join(per_label, "label").select(
        "label", "n", never_alone.alias("never_alone"),
        (never_alone & F.col("with_common")).alias("always_with_common"),
    )


def relation_frame(spark: SparkSession, relations: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(child, parent, kind) from a caller's list."""
    return spark.createDataFrame(list(relations), "child string, parent string, kind string")


def relation_check(sets: DataFrame, relations: DataFrame) -> DataFrame:
    """How often each child comes with its parent, and what that confirms.

    ``relations`` is a hand-written list; children that never occur stay.
    """
    seen = sets.select(F.explode("labels").alias("child"), "labels", "n_docs")
    both = F.when(F.array_contains(F.col("labels"), F.col("parent")), F.col("n_docs")).otherwise(0)
    matched = (
        seen.join(relations, "child")
        .groupBy("child", "parent", "kind")
        .agg(F.sum("n_docs").alias("n_child"), F.sum(both).alias("n_both"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    full = relations.join(matched, ["child", "parent", "kind"], "left").select(
        "child", "parent", "kind", zero("n_child"), zero("n_both")
    )
    rate = F.when(F.col("n_child") > 0, F.col("n_both") / F.col("n_child")).otherwise(0.0)
    return full.withColumn("rate", rate).withColumn("status", _status(F.col("rate")))


def _status(rate: Column) -> Column:
    # The words and bounds of a verdict.
    return F.when(rate > 0.9, "CONFIRMED").when(rate > 0.5, "PARTIAL").otherwise("NOT CONFIRMED")


def companions(
    directed: DataFrame, stages: Sequence[str], min_count: int = 10, min_p: float = 0.9, k: int = 15
) -> DataFrame:
    """Labels that nearly always come with a stage label, best k per stage."""
    close = directed.where(
        F.col("other").isin(*stages) & (F.col("n_given") >= min_count) & (F.col("p") > min_p)
    )
    rank = F.row_number().over(Window.partitionBy("other").orderBy(F.desc("p"), "given"))
    return close.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("other").alias("stage"), F.col("given").alias("label"), "n_given", "n", "p",
        F.col("rank").cast("bigint").alias("rank"),
    )


def family_matrix(directed: DataFrame, family: Sequence[str]) -> DataFrame:
    """Joint counts and conditionals inside a family of labels."""
    return directed.where(F.col("given").isin(*family) & F.col("other").isin(*family))


def overlap_summary(sets: DataFrame, rare_below: int = 50, common_from: int = 100) -> DataFrame:
    """One row of counts; the distinct lists, their labels and pairs are each worked out once."""
    sets = stored(sets, "label-sets")
    counts = stored(set_label_counts(sets), "label-counts")
    pairs = pair_counts(sets).agg(F.count(F.lit(1)).alias("n_pairs"), F.max("n").alias("top_pair"))
    rare = rare_companionship(sets, counts, rare_below, common_from)
    k, n = F.size("labels"), F.col("n_docs")
    in_sets = sets.agg(
        F.sum(F.when(k == 1, n).otherwise(0)).alias("n_single"),
        F.sum(F.when(k > 1, n).otherwise(0)).alias("n_multi"),
    )
    prefixes = prefix_pairs(counts).agg(F.count(F.lit(1)).alias("n_prefix"))
    alone = rare.agg(
        F.count_if("never_alone").alias("n_never_alone"), F.count_if("always_with_common").alias("n_always_with_common")
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (in_sets, pairs, prefixes, alone))
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
