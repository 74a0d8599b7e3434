"""X: label expansion, consistency rules, blended scores, volume shares.

Described for the label ontology rather than run in the analysis this package
covers; kept apart from the other families for that reason.
"""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.evaluation import flag_half
from labelweave.catalog.registry import block, query
from labelweave.operators import hierarchy as op
from labelweave.operators import metrics as met
from labelweave.operators import thresholds as th
from labelweave.plans.durable import stored

IS_A = (("q:lo:toxic", "q:lo"), ("q:lo", "quality"), ("q:hi", "quality"))
REQUIRES = {"toxic": ("lang:en", "lang:de"), "q:lo:toxic": ("q:lo",)}
EXCLUDES = (("q:hi", "q:lo"),)
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)

block(
    "levels",
    """
SELECT doc_id, label FROM assigned
UNION SELECT doc_id, 'q:lo' FROM assigned WHERE label = 'q:lo:toxic'
UNION SELECT doc_id, 'quality' FROM assigned WHERE label IN ('q:lo:toxic', 'q:lo', 'q:hi')
""",
)


@query("x01_expand_labels", "SELECT doc_id, label FROM levels")
def x01(spark, sf):
    docs = op.expand_labels(fixtures.labelled(spark, sf), IS_A)
    return docs.select("doc_id", F.explode("labels").alias("label"))


block(
    "part_tree",
    """
SELECT p_partkey AS child, CASE WHEN p_partkey = 1 THEN (SELECT max(p_partkey) FROM part) ELSE p_partkey // 2 END AS parent FROM part
""",
)


@query(
    "x01_closure",
    """
SELECT child, count(*) AS n_implied, sum(parent)::BIGINT AS implied_sum FROM (
  WITH RECURSIVE implied AS (
    SELECT child, parent FROM part_tree
    UNION SELECT i.child, t.parent FROM implied i JOIN part_tree t ON t.child = i.parent)
  SELECT DISTINCT child, parent FROM implied WHERE child <> parent) GROUP BY child
""",
)
def x01c(spark, sf):
    """The closure of a binary tree over all parts whose root points back to its last part."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    last = part.agg(F.max("p_partkey")).scalar()
    parent = F.when(F.col("p_partkey") == 1, last).otherwise(F.expr("p_partkey div 2"))
    implied = op.closure(part.select(F.col("p_partkey").alias("child"), parent.cast("bigint").alias("parent")))
    return implied.groupBy("child").agg(F.count(F.lit(1)).alias("n_implied"), F.sum("parent").alias("implied_sum"))


block("pred_half", "SELECT doc_id, coalesce(list(label ORDER BY label) FILTER (p1 >= 500), []) AS pl FROM cell_p GROUP BY doc_id")
block(
    "ruled",
    """
SELECT doc_id, pl, r1, list_contains(pl, 'toxic') AND NOT list_has_any(pl, ['lang:en', 'lang:de']) AS v1,
  list_contains(pl, 'q:lo:toxic') AND NOT list_contains(pl, 'q:lo') AS v2,
  list_contains(pl, 'q:hi') AND list_contains(pl, 'q:lo') AS v3,
  list_filter(r1, lambda x: NOT (x = 'toxic' AND NOT list_has_any(r1, ['lang:en', 'lang:de']))
    AND NOT (x = 'q:lo:toxic' AND NOT list_contains(r1, 'q:lo'))) AS fixed
FROM (SELECT doc_id, pl, list_filter(pl, lambda x: NOT (x = 'q:lo' AND list_contains(pl, 'q:hi'))) AS r1 FROM pred_half)
""",
)


def checked(spark, sf):
    docs = fixtures.scored(spark, sf).withColumn("y_pred", met.predicted("cells", "p1", 500))
    return op.check_constraints(docs, REQUIRES, EXCLUDES)


@query("x02_repair_labels", "SELECT doc_id, array_to_string(fixed, ',') AS repaired FROM ruled")
def x02(spark, sf):
    return checked(spark, sf).select("doc_id", F.array_join(F.sort_array("repaired"), ",").alias("repaired"))


@query(
    "x02_violation_rate",
    """
SELECT count(*) AS n_docs, count_if(v1 OR v2 OR v3)::BIGINT AS n_violating,
  round(avg((v1 OR v2 OR v3)::INT), 6) AS violation_rate FROM ruled
""",
)
def x02r(spark, sf):
    return op.violation_rate(checked(spark, sf)).withColumn("violation_rate", F.round("violation_rate", 6))


@query(
    "x02_violation_counts",
    """
SELECT rule, n_docs FROM (SELECT 'requires:toxic' AS rule, count_if(v1)::BIGINT AS n_docs FROM ruled
  UNION ALL SELECT 'requires:q:lo:toxic', count_if(v2)::BIGINT FROM ruled
  UNION ALL SELECT 'excludes:q:hi|q:lo', count_if(v3)::BIGINT FROM ruled) WHERE n_docs > 0
""",
)
def x02c(spark, sf):
    return op.violation_counts(checked(spark, sf))


block(
    "blend_points",
    """
SELECT label, alpha, t, CASE WHEN np > 0 AND np < k THEN coalesce(2 * tp / nullif(np + s, 0), 0) END AS f
FROM (SELECT label, alpha, t, count_if(y AND p >= t) AS tp, count_if(p >= t) AS np, count_if(y) AS s, count(*) AS k
  FROM (SELECT *, alpha * p1 + (1 - alpha) * p2 AS p FROM cell_p,
    (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS alpha) WHERE split = 'val'),
    (SELECT unnest(range(100, 901, 50))::INT AS t) GROUP BY label, alpha, t)
""",
)


@query(
    "x03_blended_thresholds",
    """
SELECT label, coalesce(alpha, 0) AS alpha, coalesce(t, 500) AS threshold, round(coalesce(f, 0), 6) AS f1
FROM label_n LEFT JOIN (SELECT * FROM blend_points WHERE f > 0
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY f DESC, alpha, t) = 1) USING (label)
""",
)
def x03(spark, sf):
    val = stored(fixtures.scored(spark, sf).where(F.col("split") == "val"), "scored")
    best = th.per_class_blend(val, fixtures.classes(spark, sf), ALPHAS)
    return best.withColumn("f1", F.round("f1", 6))


@query(
    "x04_volume_by_feasibility",
    """
SELECT CASE WHEN high_confidence THEN 'high_confidence' WHEN automation_feasible THEN 'feasible'
  WHEN needs_review THEN 'needs_review' ELSE 'not_feasible' END AS tier, count(*) AS n_classes,
  sum(support)::BIGINT AS volume, round(sum(support) / (SELECT sum(support) FROM flag_half), 6) AS share
FROM flag_half GROUP BY tier
""",
)
def x04(spark, sf):
    return met.volume_by_feasibility(flag_half(spark, sf)).withColumn("share", F.round("share", 6))
