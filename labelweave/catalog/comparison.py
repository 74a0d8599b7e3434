"""M: two models compared and combined."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.evaluation import metrics_sql, per_class_sql
from labelweave.catalog.registry import block, query
from labelweave.operators import comparison as op
from labelweave.operators import metrics as met
from labelweave.plans.durable import stored


def dense(split: str) -> str:
    return f"""
SELECT 'model1' AS cfg, doc_id, label, y, p1 >= 600 AS pred FROM cell_p WHERE split = '{split}'
UNION ALL SELECT 'model2', doc_id, label, y, p2 >= 600 FROM cell_p WHERE split = '{split}'
"""


def versus(split: str) -> str:
    return f"""
SELECT label, a.f1 AS f1_model1, b.f1 AS f1_model2, abs(a.f1 - b.f1) AS f1_gap, agreement, a.support AS support,
  CASE WHEN a.f1 > b.f1 THEN 'model1' ELSE 'model2' END AS better_model,
  CASE WHEN a.f1 > b.f1 THEN 'model1' WHEN b.f1 > a.f1 THEN 'model2' ELSE 'tie' END AS better_or_tie
FROM ({per_class_sql(f"pair_{split}")}) a JOIN ({per_class_sql(f"pair_{split}")}) b USING (label)
JOIN (SELECT label, avg(((p1 >= 600) = (p2 >= 600))::INT) AS agreement FROM cell_p WHERE split = '{split}'
  GROUP BY label) USING (label)
WHERE a.cfg = 'model1' AND b.cfg = 'model2'
"""


for _split in ("val", "test"):
    block(f"pair_{_split}", dense(_split))
    block(f"versus_{_split}", versus(_split))

block(
    "vote",
    """
SELECT doc_id, label, y, p1 >= 600 AS a, p2 >= 600 AS b, better_model = 'model2' AS pick_best,
  NOT (f1_model1 > f1_model2 + 0.05::DOUBLE) AS pick_weighted
FROM cell_p JOIN versus_val USING (label) WHERE split = 'test'
""",
)
block(
    "dense_votes",
    """
SELECT 'model1' AS cfg, doc_id, label, y, a AS pred FROM vote
UNION ALL SELECT 'model2', doc_id, label, y, b FROM vote
UNION ALL SELECT 'union', doc_id, label, y, a OR b FROM vote
UNION ALL SELECT 'intersection', doc_id, label, y, a AND b FROM vote
UNION ALL SELECT 'best_per_class', doc_id, label, y, CASE WHEN pick_best THEN b ELSE a END FROM vote
UNION ALL SELECT 'weighted', doc_id, label, y, CASE WHEN pick_weighted THEN b ELSE a END FROM vote
""",
)
block("metric_votes", metrics_sql("dense_votes"))
block(
    "long_votes",
    """
UNPIVOT (SELECT cfg, f1_micro, f1_macro, f1_weighted, precision_micro, recall_micro FROM metric_votes)
ON COLUMNS(* EXCLUDE cfg) INTO NAME metric VALUE v
""",
)


def pairs(spark, sf, split="test", scored=None):
    docs = (fixtures.scored(spark, sf) if scored is None else scored).where(F.col("split") == split)
    return docs.select(
        "doc_id", "y_true",
        met.predicted("cells", "p1", 600).alias("y1"), met.predicted("cells", "p2", 600).alias("y2"),
    )


def versus_df(spark, sf, split="test", tie="model2"):
    return op.per_class_comparison(pairs(spark, sf, split), fixtures.classes(spark, sf), tie)


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


F1S = ("f1_model1", "f1_model2")
R_F1S = "round(f1_model1, 6) AS f1_model1, round(f1_model2, 6) AS f1_model2"


@query(
    "m01_agreement",
    """
SELECT *, round(both_positive * 100.0 / cells, 6) AS pct_both_positive,
  round(both_negative * 100.0 / cells, 6) AS pct_both_negative, round(only_model1 * 100.0 / cells, 6) AS pct_only_model1,
  round(only_model2 * 100.0 / cells, 6) AS pct_only_model2,
  round((both_positive + both_negative) / cells, 6) AS agreement_rate,
  round((only_model1 + only_model2) / cells, 6) AS disagreement_rate
FROM (SELECT count(*) AS cells, count_if(a AND b)::BIGINT AS both_positive,
  count_if(NOT a AND NOT b)::BIGINT AS both_negative, count_if(a AND NOT b)::BIGINT AS only_model1,
  count_if(b AND NOT a)::BIGINT AS only_model2 FROM vote)
""",
)
def m01(spark, sf):
    classes = fixtures.classes(spark, sf)
    table = op.agreement(pairs(spark, sf), classes)
    doubles = [c for c, t in table.dtypes if t == "double"]
    cells = F.col("both_positive") + F.col("both_negative") + F.col("only_model1") + F.col("only_model2")
    return r6(table, *doubles).withColumn("cells", cells)


VERSUS = f"SELECT label, {R_F1S}, round(f1_gap, 6) AS f1_gap, round(agreement, 6) AS agreement, support, %s AS better_model FROM versus_test"


@query("m02_per_class_comparison", VERSUS % "better_model")
def m02(spark, sf):
    return r6(versus_df(spark, sf), *F1S, "f1_gap", "agreement")


@query("m02_per_class_comparison_ties", VERSUS % "better_or_tie")
def m02t(spark, sf):
    return r6(versus_df(spark, sf, tie="tie"), *F1S, "f1_gap", "agreement")


def vote_query(name, strategy):
    @query(name, f"SELECT * EXCLUDE (cfg) FROM metric_votes WHERE cfg = '{strategy}'")
    def run(spark, sf):
        classes = fixtures.classes(spark, sf)
        chosen_on = versus_df(spark, sf, "val")
        combined = op.ensemble(pairs(spark, sf), strategy, chosen_on)
        return r6(met.evaluate(met.tally(combined), classes), *met.METRICS)

    return run


vote_query("m03_ensemble_union", "union")
vote_query("m04_ensemble_intersection", "intersection")
vote_query("m05_ensemble_best_per_class", "best_per_class")
vote_query("m06_ensemble_weighted", "weighted")


@query(
    "m07_metric_comparison",
    """
SELECT metric, a.v AS model1, b.v AS model2, round(b.v - a.v, 5) AS difference, round((b.v - a.v) / a.v * 100, 1) AS pct_change
FROM (FROM long_votes WHERE cfg = 'model1') a JOIN (FROM long_votes WHERE cfg = 'model2') b USING (metric)
""",
)
def m07(spark, sf):
    both = met.stacked(pairs(spark, sf), {"model1": F.col("y1"), "model2": F.col("y2")}, "model")
    metrics = met.evaluate(met.tally(both, by=["model"]), fixtures.classes(spark, sf), by=["model"])
    table = op.metric_comparison(r6(metrics, *met.METRICS), "model", "model1", "model2", met.EPOCH_METRICS)
    return table.withColumn("difference", F.round("difference", 5))


block("delta_test", "SELECT label, f1_model1, f1_model2, f1_model2 - f1_model1 AS delta_f1, support FROM versus_test")
DELTAS = f"label, {R_F1S}, round(delta_f1, 6) AS delta_f1, support"


@query(
    "m08_class_improvements",
    f"""
(SELECT 'improved' AS side, {DELTAS} FROM delta_test ORDER BY delta_test.delta_f1 DESC, label LIMIT 10)
UNION ALL (SELECT 'declined', {DELTAS} FROM delta_test ORDER BY delta_test.delta_f1, label LIMIT 5)
""",
)
def m08(spark, sf):
    deltas = op.improvements(versus_df(spark, sf))
    parts = [
        op.largest_improvements(deltas).withColumn("side", F.lit("improved")),
        op.largest_declines(deltas).withColumn("side", F.lit("declined")),
    ]
    return r6(parts[0].unionByName(parts[1]), *F1S, "delta_f1")


@query(
    "m09_improvement_counts",
    """
SELECT count_if(delta_f1 > 0)::BIGINT AS improved, count_if(delta_f1 < 0)::BIGINT AS declined,
  count_if(delta_f1 = 0)::BIGINT AS unchanged FROM delta_test
""",
)
def m09(spark, sf):
    return op.improvement_counts(op.improvements(versus_df(spark, sf)))


@query(
    "m10_complementary_classes",
    f"""
SELECT CASE WHEN f1_model1 > f1_model2 THEN 'model1' ELSE 'model2' END AS leader, label, {R_F1S},
  round(f1_gap, 6) AS f1_gap, support
FROM versus_test v WHERE v.f1_model1 > v.f1_model2 + 0.05::DOUBLE OR v.f1_model2 > v.f1_model1 + 0.05::DOUBLE
""",
)
def m10(spark, sf):
    return r6(op.complementary(versus_df(spark, sf)), *F1S, "f1_gap")


@query(
    "m11_lowest_agreement",
    f"""
SELECT label, {R_F1S}, round(agreement, 6) AS agreement, support FROM versus_test
ORDER BY versus_test.agreement, label LIMIT 10
""",
)
def m11(spark, sf):
    return r6(op.lowest_agreement(versus_df(spark, sf)), *F1S, "agreement")


@query(
    "m12_jointly_weak",
    f"SELECT label, {R_F1S}, support FROM versus_test v WHERE v.f1_model1 < 0.5 AND v.f1_model2 < 0.5",
)
def m12(spark, sf):
    return r6(op.jointly_weak(versus_df(spark, sf)), *F1S)


def strategies(spark, sf):
    """Scored once; test is judged, val compares the models."""
    scored = stored(fixtures.scored(spark, sf).where(F.col("split") != "train"), "scored", ["split"])
    classes = stored(fixtures.classes(spark, sf), "classes")
    versus = op.per_class_comparison(pairs(spark, sf, "val", scored), classes)
    table = op.strategy_table(pairs(spark, sf, "test", scored), classes, versus)
    return r6(table, "f1_micro", "f1_macro", "precision", "recall")


STRATEGIES = """
SELECT cfg AS strategy, f1_micro, f1_macro, precision_micro AS "precision", recall_micro AS recall
FROM metric_votes WHERE cfg <> 'best_per_class'
"""


@query("m13_strategy_table", STRATEGIES)
def m13(spark, sf):
    return strategies(spark, sf)


@query(
    "m13_best_strategy",
    f"""
SELECT *, round((f1_micro - (SELECT f1_micro FROM metric_votes WHERE cfg = 'model1')) * 100, 3) AS gain_pp
FROM ({STRATEGIES}) ORDER BY f1_micro DESC, strategy LIMIT 1
""",
)
def m13b(spark, sf):
    return op.best_strategy(strategies(spark, sf)).withColumn("gain_pp", F.round("gain_pp", 3))
