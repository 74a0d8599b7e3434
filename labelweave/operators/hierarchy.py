"""Label hierarchies and consistency rules applied to predictions.

A hierarchy is a table of relations of any length. Consistency rules are
hand-written lists that become constants in the plan, so applying them moves
no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.plans.durable import stored

# Paths that end at a label, or steps from it, that one task puts together at most.
CELL = 1000

# Rows of pairs in a task.
TASK_ROWS = 500_000


def relation_frame(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in pairs], "child string, parent string")


def _sizes(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """(key, a, b): how many paths end and how many steps begin at each label where both do."""
    ends = paths.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("a"))
    starts = steps.groupBy(F.col("child").alias("key")).agg(F.count(F.lit(1)).alias("b"))
    return ends.join(starts, "key")


def _extended(paths: DataFrame, steps: DataFrame) -> tuple[DataFrame, int]:
    """(child, parent, exact): each path followed by each step from its end; and the tasks for as many rows.

    A label where many paths end or many steps begin is cut into cells of at
    most ``CELL`` by ``CELL``, so that no task gets all that meet there.
    """
    sizes = stored(_sizes(paths, steps), "implied-sizes")
    total, rows = sizes.agg(F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") + F.col("b"))).first()
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-max(total or 0, rows or 0) // TASK_ROWS))
    hot = sizes.where(F.greatest("a", "b") > CELL)
    cut = lambda n: F.greatest(F.ceil(F.coalesce(F.col(n), F.lit(1)) / CELL), F.lit(1))
    own = lambda value, n: F.pmod(F.xxhash64(value), cut(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), cut(n) - 1))
    left = paths.join(hot, F.col("parent") == F.col("key"), "left").select(
        "child", F.col("parent").alias("middle"), "exact", own("child", "a").alias("i"), every("b").alias("j")
    )
    right = steps.join(hot, F.col("child") == F.col("key"), "left").select(
        F.col("child").alias("middle"), "parent", own("parent", "b").alias("j"), every("a").alias("i")
    )
    key = ["middle", "i", "j"]
    met = left.repartition(parts, *key).join(right.repartition(parts, *key), key)
    return met.select("child", "parent", "exact"), parts


def closure(relations: DataFrame) -> DataFrame:
    """(child, parent): every label that another implies, over any number of levels.

    Before each round all pairs are known up to some distance, and those at
    exactly that distance are its steps. Every known path is followed by every
    step, which doubles the distance, so a chain of n levels takes about
    log2(n) rounds and a pair is met once for each label at one distance
    before its end, not for each label between. Only new pairs go on, which
    ends cycles; no label implies itself. Each round writes what it found, in
    tasks of about ``TASK_ROWS`` rows.
    """
    proper = lambda pairs: pairs.where("child != parent")
    steps = stored(proper(relations.select("child", "parent")).distinct(), "implied")
    known = [steps.withColumn("exact", F.lit(True))]
    while True:
        paths = reduce(DataFrame.unionByName, known)
        met, parts = _extended(paths, steps)
        pairs = ["child", "parent"]
        # A pair met over a shorter way too is not one of the next steps.
        new = proper(met).repartition(parts, *pairs).groupBy(*pairs).agg(F.every("exact").alias("exact"))
        found = stored(new.join(paths.select(*pairs).repartition(parts, *pairs), pairs, "left_anti"), "implied")
        known = [k.withColumn("exact", F.lit(False)) for k in known] + [found]
        steps = found.where("exact").select(*pairs)
        if steps.isEmpty():
            return reduce(DataFrame.unionByName, known).select(*pairs)


def expand_labels(docs: DataFrame, relations: DataFrame | Sequence[tuple[str, str]], col: str = "labels") -> DataFrame:
    """Labels with everything they imply.

    ``relations`` (child, parent) is a table or a short list of pairs. The
    closure meets each distinct label list once; a list without implied
    labels, and a null one, stays as it is.
    """
    if not isinstance(relations, DataFrame):
        relations = relation_frame(docs.sparkSession, relations)
    own, implied = "_labelweave_own", "_labelweave_implied"
    lists = docs.select(F.col(col).alias(own)).distinct()
    grown = (
        lists.select(own, F.explode(own).alias("child")).join(closure(relations), "child")
        .groupBy(own).agg(F.sort_array(F.collect_set("parent")).alias(implied))
    )
    labels = F.when(F.col(implied).isNull(), F.col(col)).otherwise(F.array_distinct(F.concat(F.col(col), F.col(implied))))
    return docs.join(grown, docs[col] == grown[own], "left").withColumn(col, labels).drop(own, implied)


def violations(
    labels: Column, requires: Mapping[str, Sequence[str]], excludes: Sequence[tuple[str, str]]
) -> Column:
    """Names of the broken rules, one string per rule."""
    has = lambda label: F.array_contains(labels, label)
    broken = []
    for label, options in requires.items():
        met = F.arrays_overlap(labels, F.array(*[F.lit(o) for o in options]))
        broken.append(F.when(has(label) & ~met, F.lit(f"requires:{label}")))
    for first, second in excludes:
        broken.append(F.when(has(first) & has(second), F.lit(f"excludes:{first}|{second}")))
    return F.array_compact(F.array(*broken))


def repair(
    docs: DataFrame, requires: Mapping[str, Sequence[str]], excludes: Sequence[tuple[str, str]],
    col: str = "y_pred",
) -> DataFrame:
    """Replace ``col`` by labels that keep the rules, taken in their order.

    Of an excluded pair the first stays; then a label whose requirement is
    not met goes. One projection per rule keeps the expressions small.
    """
    has = lambda label: F.array_contains(F.col(col), label)
    for first, second in excludes:
        both = has(first) & has(second)
        docs = docs.withColumn(col, F.when(both, F.array_remove(col, second)).otherwise(F.col(col)))
    for label, options in requires.items():
        met = F.arrays_overlap(F.col(col), F.array(*[F.lit(o) for o in options]))
        docs = docs.withColumn(
            col, F.when(has(label) & ~met, F.array_remove(col, label)).otherwise(F.col(col))
        )
    return docs


def check_constraints(
    docs: DataFrame, requires: Mapping[str, Sequence[str]], excludes: Sequence[tuple[str, str]],
    col: str = "y_pred",
) -> DataFrame:
    """Add ``violations`` and ``repaired``."""
    checked = docs.withColumns(
        {"violations": violations(F.col(col), requires, excludes), "repaired": F.col(col)}
    )
    return repair(checked, requires, excludes, "repaired")


def violation_rate(checked: DataFrame) -> DataFrame:
    broken = F.size("violations") > 0
    return checked.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(broken).alias("n_violating"),
        F.avg(broken.cast("int")).alias("violation_rate"),
    )


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("violations").alias("rule")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_docs")
    )
