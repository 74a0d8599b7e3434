"""E: multi-label metrics and thresholds."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import block, query
from labelweave.operators import metrics as op
from labelweave.operators import thresholds as th
from labelweave.operators.quality import histogram, length_summary
from labelweave.plans.durable import stored

block(
    "cell_p",
    """
SELECT doc_id, split, label, y,
  CASE WHEN y THEN 350 + (h1 * 65) // 100 ELSE (h1 * 75) // 100 END AS p1,
  CASE WHEN y THEN 250 + (h2 * 75) // 100 ELSE (h2 * 70) // 100 END AS p2
FROM (SELECT doc_id, label, list_contains(labs, label) AS y,
    (doc_id * 7919 + idx * 104729) % 1000 AS h1, (doc_id * 6421 + idx * 15485) % 1000 AS h2,
    CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM corpus),
    (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM label_n))
""",
)

# Model 1 at 0.5 over all documents, as dense 0/1 cells.
block("dense_half", "SELECT 'all' AS cfg, doc_id, label, y, p1 >= 500 AS pred FROM cell_p")


def per_class_sql(rel: str) -> str:
    return f"""
SELECT cfg, label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  tp + fn AS support, tp + fp AS predicted_count
FROM (SELECT cfg, label, count_if(y AND pred)::BIGINT AS tp, count_if(NOT y AND pred)::BIGINT AS fp,
  count_if(y AND NOT pred)::BIGINT AS fn FROM {rel} GROUP BY cfg, label)
"""


def metrics_sql(rel: str) -> str:
    """Every overall metric from dense cells (cfg, doc_id, label, y, pred)."""
    return f"""
SELECT cfg,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_micro, round(f1m, 6) AS f1_macro,
  round(coalesce(f1w / nullif(tp + fn, 0), 0), 6) AS f1_weighted, round(f1s, 6) AS f1_samples,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_micro, round(pm, 6) AS precision_macro,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_micro, round(rm, 6) AS recall_macro,
  round((fp + fn) / cells, 6) AS hamming_loss, round(ex, 6) AS exact_match
FROM (SELECT cfg, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS f1m, sum(f1 * support) AS f1w,
    avg("precision") AS pm, avg(recall) AS rm FROM ({per_class_sql(rel)}) GROUP BY cfg)
JOIN (SELECT cfg, avg(coalesce(2 * c / nullif(s, 0), 0)) AS f1s, avg(ex) AS ex, sum(k) AS cells
  FROM (SELECT cfg, doc_id, count_if(y AND pred) AS c, count_if(y) + count_if(pred) AS s,
    bool_and(y = pred)::INT AS ex, count(*) AS k FROM {rel} GROUP BY cfg, doc_id) GROUP BY cfg) USING (cfg)
"""


block("class_half", per_class_sql("dense_half"))
block("metric_half", metrics_sql("dense_half"))
block(
    "flag_half",
    """
SELECT label, f1, support, f1 >= 0.63::DOUBLE AS automation_feasible, f1 >= 0.93::DOUBLE AS high_confidence,
  f1 >= 0.504::DOUBLE AND f1 < 0.63::DOUBLE AS needs_review
FROM class_half
""",
)


def half(spark, sf):
    return fixtures.scored(spark, sf).withColumn("y_pred", op.predicted("cells", "p1", 500))


def class_half(spark, sf):
    return op.per_class(op.tally(half(spark, sf)), fixtures.classes(spark, sf))


def flag_half(spark, sf):
    return op.feasibility(class_half(spark, sf))


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def overall(spark, sf, *columns):
    row = op.evaluate(op.tally(half(spark, sf)), fixtures.classes(spark, sf))
    return r6(row.select(*columns), *columns)


def overall_query(name, *columns):
    query(name, f"SELECT {', '.join(columns)} FROM metric_half")(
        lambda spark, sf: overall(spark, sf, *columns)
    )


overall_query("e01_micro", "f1_micro", "precision_micro", "recall_micro")
overall_query("e02_macro", "f1_macro", "precision_macro", "recall_macro")
overall_query("e03_weighted", "f1_weighted")
overall_query("e04_samples", "f1_samples")
overall_query("e05_hamming_loss", "hamming_loss")
overall_query("e06_exact_match", "exact_match")
overall_query("e07_evaluate", *op.METRICS)
overall_query("e25_epoch_metrics", *op.EPOCH_METRICS)

CLASS_COLUMNS = 'label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support'


def class_rounded(df):
    return r6(df, "precision", "recall", "f1")


@query("e07_per_class", f"SELECT {CLASS_COLUMNS}, predicted_count FROM class_half")
def e07(spark, sf):
    return class_rounded(op.by_support(class_half(spark, sf)))


@query("e08_top_classes", f"SELECT {CLASS_COLUMNS}, predicted_count FROM class_half ORDER BY class_half.f1 DESC, label LIMIT 10")
def e08(spark, sf):
    return class_rounded(op.top_classes(class_half(spark, sf)))


@query("e09_bottom_classes", f"SELECT {CLASS_COLUMNS}, predicted_count FROM class_half ORDER BY class_half.f1, label LIMIT 10")
def e09(spark, sf):
    return class_rounded(op.bottom_classes(class_half(spark, sf)))


@query("e10_feasibility", "SELECT * REPLACE (round(f1, 6) AS f1) FROM flag_half")
def e10(spark, sf):
    return r6(flag_half(spark, sf), "f1")


block("dense_models", """
SELECT 'm1' AS cfg, doc_id, label, y, p1 >= 700 AS pred FROM cell_p
UNION ALL SELECT 'm2', doc_id, label, y, p2 >= 700 FROM cell_p
""")
block("class_models", per_class_sql("dense_models"))
block("category_models", """
SELECT cfg, category, n FROM (SELECT cfg, count_if(f1 >= 0.63::DOUBLE)::BIGINT AS feasible,
  count_if(f1 >= 0.93::DOUBLE)::BIGINT AS high_confidence,
  count_if(f1 >= 0.504::DOUBLE AND f1 < 0.63::DOUBLE)::BIGINT AS needs_review,
  count_if(f1 < 0.504::DOUBLE)::BIGINT AS not_feasible FROM class_models GROUP BY cfg)
UNPIVOT (n FOR category IN (feasible, high_confidence, needs_review, not_feasible))
""")


@query(
    "e11_feasibility_comparison",
    """
SELECT category, a.n AS m1, b.n AS m2, b.n - a.n AS change
FROM category_models a JOIN category_models b USING (category) WHERE a.cfg = 'm1' AND b.cfg = 'm2'
""",
)
def e11(spark, sf):
    docs, classes = fixtures.scored(spark, sf), fixtures.classes(spark, sf)
    flags = []
    for name, p in (("m1", "p1"), ("m2", "p2")):
        scored = docs.withColumn("y_pred", op.predicted("cells", p, 700))
        table = op.feasibility(op.per_class(op.tally(scored), classes))
        flags.append(table.withColumn("model", F.lit(name)))
    return op.feasibility_comparison(flags[0].unionByName(flags[1]), "model", ("m1", "m2"))


@query(
    "e12_support_tiers",
    """
SELECT CASE WHEN support <= 50 THEN '<50' WHEN support <= 100 THEN '50-100' WHEN support <= 500 THEN '100-500'
  WHEN support <= 1000 THEN '500-1000' ELSE '1000+' END AS tier,
  round(avg(f1), 3) AS f1_mean, round(stddev_samp(f1), 3) AS f1_std, count(*) AS n_classes
FROM class_half WHERE support > 0 GROUP BY tier
""",
)
def e12(spark, sf):
    return op.support_tiers(class_half(spark, sf))


@query("e13_classification_report", f'SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1_score, support FROM class_half')
def e13(spark, sf):
    return r6(op.classification_report(class_half(spark, sf)), "precision", "recall", "f1_score")


def sweep_sql(split: str, top: int, p: str = "p1") -> str:
    return f"""
SELECT t AS threshold, coalesce(2 * sum(tp) / nullif(sum(np) + sum(s), 0), 0) AS f1_micro,
  avg(coalesce(2 * tp / nullif(np + s, 0), 0)) AS f1_macro, coalesce(sum(tp) / nullif(sum(np), 0), 0) AS "precision",
  coalesce(sum(tp) / nullif(sum(s), 0), 0) AS recall, sum(np) / max(n_docs) AS avg_preds
FROM (SELECT t, label, count_if(y AND {p} >= t) AS tp, count_if({p} >= t) AS np, count_if(y) AS s, count(*) AS n_docs
  FROM cell_p, (SELECT unnest(range(100, {top}, 100))::INT AS t) WHERE split = '{split}' GROUP BY t, label)
GROUP BY t
"""


block("sweep_val", sweep_sql("val", 901))
block("sweep_eval", sweep_sql("val", 801, "p2"))

SWEEP_COLUMNS = ("f1_micro", "f1_macro", "precision", "recall", "avg_preds")


def val_sweep(spark, sf, p="p1", grid=th.SWEEP_GRID):
    docs = fixtures.scored(spark, sf).where(F.col("split") == "val")
    counts = th.sweep_counts(docs, p, grid)
    return th.threshold_sweep(counts, fixtures.classes(spark, sf), th.document_count(docs))


@query(
    "e14_threshold_sweep",
    """
SELECT threshold, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro,
  round("precision", 6) AS "precision", round(recall, 6) AS recall FROM sweep_val
""",
)
def e14(spark, sf):
    return r6(val_sweep(spark, sf).drop("avg_preds"), *SWEEP_COLUMNS[:4])


@query(
    "e15_threshold_sweep_predictions",
    """
SELECT threshold, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro,
  round("precision", 6) AS "precision", round(recall, 6) AS recall, round(avg_preds, 6) AS avg_preds FROM sweep_eval
""",
)
def e15(spark, sf):
    return r6(val_sweep(spark, sf, "p2", th.EVALUATION_GRID), *SWEEP_COLUMNS)


@query(
    "e16_best_threshold",
    "SELECT threshold, round(f1_micro, 6) AS f1_micro FROM sweep_val ORDER BY sweep_val.f1_micro DESC, threshold LIMIT 1",
)
def e16(spark, sf):
    return r6(th.best_threshold(val_sweep(spark, sf)).select("threshold", "f1_micro"), "f1_micro")


def class_threshold_sql(p: str) -> str:
    return f"""
SELECT label, coalesce(t, 500) AS threshold, coalesce(f_default, 0) AS f1_default, coalesce(f, 0) AS f1_best,
  coalesce(f, 0) - coalesce(f_default, 0) AS improvement, s AS support
FROM (SELECT label, max(s) AS s, max(f) FILTER (t = 500) AS f_default FROM points_{p} GROUP BY label)
LEFT JOIN (SELECT label, t, f FROM points_{p} WHERE f > 0
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY f DESC, t) = 1) USING (label)
"""


for _p in ("p1", "p2"):
    block(
        f"points_{_p}",
        f"""
SELECT label, t, s, CASE WHEN np > 0 AND np < k THEN coalesce(2 * tp / nullif(np + s, 0), 0) END AS f
FROM (SELECT label, t, count_if(y AND {_p} >= t) AS tp, count_if({_p} >= t) AS np, count_if(y)::BIGINT AS s, count(*) AS k
  FROM cell_p, (SELECT unnest(range(100, 901, 50))::INT AS t) WHERE split = 'val' GROUP BY label, t)
""",
    )
    block(f"best_{_p}", class_threshold_sql(_p))


def class_thresholds(spark, sf, p="p1"):
    docs = fixtures.scored(spark, sf).where(F.col("split") == "val")
    counts = th.sweep_counts(docs, p, th.CLASS_GRID)
    return th.per_class_thresholds(counts, fixtures.classes(spark, sf), th.document_count(docs))


THRESHOLD_COLUMNS = """
SELECT label, threshold, round(f1_default, 6) AS f1_default, round(f1_best, 6) AS f1_best,
  round(improvement, 6) AS improvement, support FROM best_p1
"""


@query("e17_per_class_thresholds", THRESHOLD_COLUMNS)
def e17(spark, sf):
    return r6(class_thresholds(spark, sf), "f1_default", "f1_best", "improvement")


block(
    "points_off",
    """
SELECT label, t, s, CASE WHEN np > 0 AND np < k THEN coalesce(2 * tp / nullif(np + s, 0), 0) END AS f
FROM (SELECT label, t, count_if(y AND p1 >= t) AS tp, count_if(p1 >= t) AS np, count_if(y)::BIGINT AS s, count(*) AS k
  FROM cell_p, (SELECT unnest([150, 350, 500, 550, 750])::INT AS t) WHERE split = 'val' GROUP BY label, t)
""",
)
block("best_off", class_threshold_sql("off").replace("WHERE f > 0", "WHERE f > 0 AND t <> 500"))


@query("e17_default_off_the_grid", "SELECT label, threshold, round(f1_default, 6) AS f1_default, round(f1_best, 6) AS f1_best FROM best_off")
def e17o(spark, sf):
    grid = (150, 350, 550, 750)
    docs = fixtures.scored(spark, sf).where(F.col("split") == "val")
    counts = th.sweep_counts(docs, "p1", (*grid, th.DEFAULT_THRESHOLD))
    found = th.per_class_thresholds(counts, fixtures.classes(spark, sf), th.document_count(docs), grid=grid)
    return r6(found.select("label", "threshold", "f1_default", "f1_best"), "f1_default", "f1_best")


@query("e20_most_improved", THRESHOLD_COLUMNS + " ORDER BY best_p1.improvement DESC, label LIMIT 10")
def e20i(spark, sf):
    return r6(th.most_improved(class_thresholds(spark, sf)), "f1_default", "f1_best", "improvement")


@query(
    "e20_threshold_summary",
    """
SELECT count(*) AS n, round(avg(threshold), 6) AS mean, round(stddev_samp(threshold), 6) AS std,
  min(threshold)::DOUBLE AS min, quantile_cont(threshold, 0.25) AS q25, median(threshold) AS median,
  quantile_cont(threshold, 0.75) AS q75, max(threshold)::DOUBLE AS max FROM best_p1
""",
)
def e20(spark, sf):
    return r6(th.threshold_summary(class_thresholds(spark, sf)), "mean", "std")


block("dense_tuned", """
SELECT 'tuned' AS cfg, doc_id, label, y, p1 >= threshold AS pred FROM cell_p JOIN best_p1 USING (label) WHERE split = 'test'
""")
block("dense_global", "SELECT 'global' AS cfg, doc_id, label, y, p1 >= 600 AS pred FROM cell_p WHERE split = 'test'")
block("dense_default", "SELECT 'half' AS cfg, doc_id, label, y, p1 >= 500 AS pred FROM cell_p WHERE split = 'test'")
block("dense_model2", "SELECT 'model2' AS cfg, doc_id, label, y, p2 >= 500 AS pred FROM cell_p WHERE split = 'test'")
block("dense_configs", "FROM dense_tuned UNION ALL FROM dense_global UNION ALL FROM dense_default UNION ALL FROM dense_model2")
block("metric_configs", metrics_sql("dense_configs"))
block("long_configs", "UNPIVOT (SELECT * FROM metric_configs) ON COLUMNS(* EXCLUDE cfg) INTO NAME metric VALUE v")


def test_docs(spark, sf):
    return fixtures.scored(spark, sf).where(F.col("split") == "test")


@query("e18_apply_class_thresholds", "SELECT * EXCLUDE (cfg) FROM metric_configs WHERE cfg = 'tuned'")
def e18(spark, sf):
    tuned = th.apply_class_thresholds(test_docs(spark, sf), class_thresholds(spark, sf), "p1")
    return r6(op.evaluate(op.tally(tuned), fixtures.classes(spark, sf)), *op.METRICS)


@query("e19_apply_global_threshold", "SELECT * EXCLUDE (cfg) FROM metric_configs WHERE cfg = 'global'")
def e19(spark, sf):
    docs = test_docs(spark, sf).withColumn("y_pred", op.predicted("cells", "p1", 600))
    return r6(op.evaluate(op.tally(docs), fixtures.classes(spark, sf)), *op.METRICS)


def histogram_sql(col: str, src: str, bins: int) -> str:
    return f"""
SELECT bin, round(a + bin * ((b - a) / {bins}), 6) AS low, round(a + (bin + 1) * ((b - a) / {bins}), 6) AS high,
  coalesce(n, 0) AS n
FROM (SELECT min({col})::DOUBLE AS a, max({col})::DOUBLE AS b FROM {src}), (SELECT unnest(range({bins})) AS bin)
LEFT JOIN (SELECT least(floor(({col} - a) * {bins} / (b - a)), {bins - 1})::BIGINT AS bin, count(*) AS n
  FROM {src}, (SELECT min({col})::DOUBLE AS a, max({col})::DOUBLE AS b FROM {src}) GROUP BY 1) USING (bin)
"""


block("cell_test", "SELECT * FROM cell_p WHERE split = 'test'")


@query("e21_probability_histogram", histogram_sql("p1", "cell_test", 50))
def e21(spark, sf):
    return r6(th.probability_histogram(test_docs(spark, sf), "p1"), "low", "high")


# Probabilities that nearly all differ, as a real model gives them.
block("cell_real", "SELECT sqrt(p1 * 1000.0 + (doc_id * 31) % 997 + 1) AS v FROM cell_test")


@query("e21_real_valued_histogram", histogram_sql("v", "cell_real", 50))
def e21r(spark, sf):
    noise = (F.col("doc_id") * 31) % 997 + 1
    real = F.transform("cells", lambda c: F.struct(F.sqrt(c["p1"] * 1000.0 + noise).alias("v")))
    docs = test_docs(spark, sf).withColumn("cells", real)
    return r6(th.probability_histogram(docs, "v"), "low", "high")


block("doc_preds", "SELECT doc_id, count_if(pred)::BIGINT AS k FROM dense_default GROUP BY doc_id")


def doc_preds(spark, sf):
    docs = test_docs(spark, sf).withColumn("y_pred", op.predicted("cells", "p1", 500))
    return op.predictions_per_document(docs)


@query("e22_predictions_per_document", "SELECT k AS value, count(*) AS n FROM doc_preds GROUP BY k")
def e22(spark, sf):
    return doc_preds(spark, sf)


@query(
    "e22_predictions_per_document_stats",
    """
SELECT round(avg(k), 6) AS mean_predictions, max(k) AS max_predictions, count_if(k = 0)::BIGINT AS n_without,
  round(count_if(k = 0) * 100.0 / count(*), 6) AS pct_without FROM doc_preds
""",
)
def e22s(spark, sf):
    return r6(op.predictions_per_document_stats(doc_preds(spark, sf)), "mean_predictions", "pct_without")


@query("e23_f1_histogram", histogram_sql("f1", "class_half", 20))
def e23(spark, sf):
    return r6(histogram(op.f1_values(class_half(spark, sf)), 20), "low", "high")


@query(
    "e23_f1_bands",
    """
SELECT label, round(f1, 6) AS f1,
  CASE WHEN f1 >= 0.63::DOUBLE THEN 'automatable' WHEN f1 >= 0.5 THEN 'review' ELSE 'human' END AS band,
  (SELECT round(median(f1), 6) FROM class_half) AS median_f1
FROM class_half
""",
)
def e23b(spark, sf):
    classes = class_half(spark, sf)
    median = length_summary(op.f1_values(classes)).select("median").scalar()
    return classes.select(
        "label", F.round("f1", 6).alias("f1"), op.f1_band(F.col("f1")).alias("band"), F.round(median, 6).alias("median_f1")
    )


@query(
    "e24_configuration_comparison",
    """
SELECT metric, h.v AS half, g.v AS "global", t.v AS tuned, m.v AS model2, round(g.v - h.v, 5) AS gap_global,
  round(t.v - h.v, 5) AS gap_tuned, round(m.v - h.v, 5) AS gap_model2
FROM (FROM long_configs WHERE cfg = 'half') h JOIN (FROM long_configs WHERE cfg = 'global') g USING (metric)
JOIN (FROM long_configs WHERE cfg = 'tuned') t USING (metric) JOIN (FROM long_configs WHERE cfg = 'model2') m USING (metric)
""",
)
def e24(spark, sf):
    """Three thresholds of one model, and a second model; scored once."""
    scored = stored(fixtures.scored(spark, sf), "scored", ["split"])
    classes = stored(fixtures.classes(spark, sf), "classes")
    val = scored.where(F.col("split") == "val")
    limits = th.per_class_thresholds(th.sweep_counts(val, "p1", th.CLASS_GRID), classes, th.document_count(val))
    tuned = th.apply_class_thresholds(scored.where(F.col("split") == "test"), limits, "p1")
    configs = {
        "half": op.predicted("cells", "p1", 500),
        "global": op.predicted("cells", "p1", 600),
        "tuned": F.col("y_pred"),
        "model2": op.predicted("cells", "p2", 500),
    }
    tallied = op.tally(op.stacked(tuned, configs), by=["config"])
    metrics = r6(op.evaluate(tallied, classes, by=["config"]), *op.METRICS)
    table = op.compare_configurations(metrics, "config", tuple(configs), "half")
    return table.withColumns({c: F.round(c, 5) for c in ("gap_global", "gap_tuned", "gap_model2")})


@query(
    "e26_feasible_classes",
    """
(SELECT 'by_f1' AS listing, label, round(f1, 6) AS f1, support FROM flag_half WHERE automation_feasible)
UNION ALL (SELECT 'by_support', label, round(f1, 6), support FROM flag_half WHERE automation_feasible
  ORDER BY support DESC, label LIMIT 15)
""",
)
def e26(spark, sf):
    flags = flag_half(spark, sf)
    parts = [
        op.feasible_classes(flags).withColumn("listing", F.lit("by_f1")),
        op.feasible_classes(flags, 15).withColumn("listing", F.lit("by_support")),
    ]
    return r6(parts[0].unionByName(parts[1]), "f1")


@query(
    "e27_deployment_tiers",
    """
SELECT count_if(high_confidence)::BIGINT AS full_automation,
  (count_if(automation_feasible) - count_if(high_confidence))::BIGINT AS assisted,
  count_if(needs_review)::BIGINT AS human_review, count_if(f1 < 0.504::DOUBLE)::BIGINT AS human_only,
  round(count_if(automation_feasible) / count(*), 6) AS gain FROM flag_half
""",
)
def e27(spark, sf):
    return r6(op.deployment_tiers(flag_half(spark, sf)), "gain")


@query(
    "h14_predict_threshold",
    """
SELECT doc_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (p2 >= 500), '') AS ones, count_if(p2 < 500)::BIGINT AS n_zeros
FROM cell_p GROUP BY doc_id
""",
)
def h14(spark, sf):
    decided = th.decisions(fixtures.scored(spark, sf), "p2", 500)
    return decided.withColumn("ones", F.array_join(F.sort_array("ones"), ","))


@query(
    "h15_validation_rule",
    "SELECT doc_id, count_if(p2 > 500)::BIGINT AS n_strict, count_if(p2 >= 500)::BIGINT AS n_loose FROM cell_p GROUP BY doc_id",
)
def h15(spark, sf):
    size = lambda strict: F.size(op.predicted("cells", "p2", 500, strict)).cast("bigint")
    return fixtures.scored(spark, sf).select(
        "doc_id", size(True).alias("n_strict"), size(False).alias("n_loose")
    )
