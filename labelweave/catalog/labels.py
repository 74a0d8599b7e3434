"""L: label counts, tiers and labels-per-document statistics."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import block, query
from labelweave.operators import documents as doc
from labelweave.operators import labels as op
from labelweave.plans.durable import stored

block(
    "label_tier",
    """
SELECT label, n, CASE WHEN n >= 100 THEN 'common' WHEN n >= 10 THEN 'moderate' ELSE 'rare' END AS tier
FROM label_n
""",
)
block("set_size", "SELECT len(labs)::BIGINT AS k, count(*) AS n_docs FROM corpus GROUP BY k")


def counts(spark, sf):
    return op.label_counts(fixtures.labelled(spark, sf))


def sets(spark, sf):
    return op.label_sets(fixtures.labelled(spark, sf))


def r6(name):
    return F.round(name, 6).alias(name)


@query("l01_label_distribution", "SELECT label, n FROM label_n")
def l01(spark, sf):
    return op.label_distribution(counts(spark, sf))


@query("l01_label_distribution_baskets", "SELECT label, n FROM basket_n")
def l01b(spark, sf):
    return op.label_distribution(op.label_counts(fixtures.baskets(spark, sf)))


@query("l02_distinct_labels", "SELECT count(*) AS n_labels FROM label_n")
def l02(spark, sf):
    return op.distinct_labels(fixtures.labelled(spark, sf))


@query(
    "l02_distinct_labels_of_parts",
    """
WITH named AS (SELECT l_linenumber::INT AS part, 'p:' || l_partkey AS label FROM lineitem
  UNION ALL SELECT l_linenumber::INT, 'o:' || l_orderkey FROM lineitem)
SELECT part, count(DISTINCT label) AS n_labels, true AS within_error FROM named GROUP BY part
UNION ALL SELECT 0, count(DISTINCT label), true FROM named
""",
)
def l02p(spark, sf):
    """Exact counts, and whether the stored sketches of each part and of all (part 0) come within their error."""
    docs = fixtures.shipped(spark, sf)
    sketches = stored(op.label_sketches(docs), "label-sketches")
    labels = docs.select("part", F.explode("labels").alias("label"))
    exact = labels.groupBy("part").agg(F.countDistinct("label").alias("n_labels"))
    exact = exact.unionByName(op.distinct_labels(docs).select(F.lit(0).alias("part"), "n_labels"))
    guessed = sketches.select("part", F.hll_sketch_estimate("sketch").alias("guess")).unionByName(
        op.sketched_labels(sketches).select(F.lit(0).alias("part"), F.col("n_labels").alias("guess"))
    )
    near = F.abs(F.col("guess") - F.col("n_labels")) <= op.sketch_error() * F.col("n_labels")
    return exact.join(guessed, "part").select("part", "n_labels", near.alias("within_error"))


@query(
    "l03_corpus_statistics",
    """
SELECT count(*) AS n_docs, sum(n_paragraphs)::BIGINT AS total_paragraphs,
  round(avg(n_paragraphs), 6) AS avg_paragraphs, round(avg(n_words), 6) AS avg_words,
  min(n_words) AS min_words, max(n_words) AS max_words, median(n_words) AS median_words,
  (SELECT count(*) FROM label_n) AS n_labels
FROM texts
""",
)
def l03(spark, sf):
    stats = op.corpus_statistics(doc.with_counts(fixtures.sectioned(spark, sf)), counts(spark, sf))
    return stats.withColumns(
        {"avg_paragraphs": F.round("avg_paragraphs", 6), "avg_words": F.round("avg_words", 6)}
    )


@query(
    "l04_top_labels_share",
    """
SELECT label, n, round(n * 100.0 / (SELECT count(*) FROM corpus), 6) AS pct_docs
FROM label_n ORDER BY n DESC, label LIMIT 10
""",
)
def l04(spark, sf):
    docs = fixtures.labelled(spark, sf)
    top = op.with_share(op.top_labels(op.label_counts(docs), 10), docs)
    return top.select("label", "n", r6("pct_docs"))


@query("l05_imbalance_ratio", "SELECT round(max(n) / min(n), 6) AS imbalance_ratio FROM label_n")
def l05(spark, sf):
    return op.imbalance_ratio(counts(spark, sf)).select(r6("imbalance_ratio"))


@query(
    "l06_frequency_tiers",
    """
SELECT label, n, round(n / (SELECT sum(n) FROM label_n), 6) AS share, tier, n = 1 AS singleton FROM label_tier
""",
)
def l06(spark, sf):
    table = counts(spark, sf)
    total = table.agg(F.sum("n")).scalar()
    return op.with_tier(table).select(
        "label", "n", F.round(F.col("n") / total, 6).alias("share"), "tier", (F.col("n") == 1).alias("singleton")
    )


@query(
    "l07_taxonomy_summary",
    """
SELECT count(*) AS total_unique, count_if(tier = 'common')::BIGINT AS common_count,
  count_if(tier = 'moderate')::BIGINT AS moderate_count, count_if(tier = 'rare')::BIGINT AS rare_count,
  count_if(n = 1)::BIGINT AS singleton_count, sum(n)::BIGINT AS total_assignments,
  round(sum(CASE WHEN tier = 'common' THEN n ELSE 0 END) / sum(n), 6) AS common_coverage
FROM label_tier
""",
)
def l07(spark, sf):
    return op.taxonomy_summary(counts(spark, sf)).withColumn("common_coverage", F.round("common_coverage", 6))


@query(
    "l08_modeling_subset",
    """
SELECT label, n, round((SELECT sum(n) FROM label_n WHERE n >= 50) / (SELECT sum(n) FROM label_n), 6) AS coverage
FROM label_n WHERE n >= 50
""",
)
def l08(spark, sf):
    table = counts(spark, sf)
    coverage = op.subset_coverage(table).select("coverage").scalar()
    return op.modeling_subset(table).select("label", "n", F.round(coverage, 6).alias("coverage"))


@query("l09_taxonomy_table", "SELECT label, n, tier FROM label_tier")
def l09(spark, sf):
    return op.label_distribution(op.with_tier(counts(spark, sf)))


@query(
    "l10_threshold_counters",
    """
SELECT count_if(n = 1)::BIGINT AS n_once, count_if(n < 10)::BIGINT AS n_below_moderate,
  count_if(n < 100)::BIGINT AS n_below_common, count_if(n >= 100)::BIGINT AS n_common
FROM label_n
""",
)
def l10(spark, sf):
    return op.threshold_counters(counts(spark, sf))


@query(
    "l11_top_bottom_labels",
    """
(SELECT 'top' AS side, label, n FROM label_n ORDER BY n DESC, label LIMIT 20)
UNION ALL (SELECT 'bottom' AS side, label, n FROM label_n ORDER BY n, label LIMIT 20)
""",
)
def l11(spark, sf):
    table = counts(spark, sf)
    side = lambda name, df: df.select(F.lit(name).alias("side"), "label", "n")
    return side("top", op.top_labels(table)).unionAll(side("bottom", op.bottom_labels(table)))


@query(
    "l12_labels_per_document",
    "SELECT k, n_docs, round(n_docs * 100.0 / (SELECT sum(n_docs) FROM set_size), 6) AS pct FROM set_size",
)
def l12(spark, sf):
    return op.labels_per_document(sets(spark, sf)).select("k", "n_docs", r6("pct"))


@query(
    "l12_labels_per_document_stats",
    """
SELECT min(len(labs))::BIGINT AS min_labels, max(len(labs))::BIGINT AS max_labels,
  round(avg(len(labs)), 6) AS mean_labels, median(len(labs)) AS median_labels
FROM corpus
""",
)
def l12s(spark, sf):
    return op.labels_per_document_stats(sets(spark, sf)).withColumn("mean_labels", F.round("mean_labels", 6))


@query(
    "l13_label_cardinality_shares",
    """
SELECT count(*) AS n_docs, count_if(len(labs) = 0)::BIGINT AS n_zero, count_if(len(labs) = 1)::BIGINT AS n_single,
  count_if(len(labs) > 1)::BIGINT AS n_multi, round(n_zero * 100.0 / n_docs, 6) AS pct_zero,
  round(n_single * 100.0 / n_docs, 6) AS pct_single, round(n_multi * 100.0 / n_docs, 6) AS pct_multi
FROM corpus
""",
)
def l13(spark, sf):
    shares = op.label_cardinality_shares(sets(spark, sf))
    return shares.withColumns({c: F.round(c, 6) for c in shares.columns if c.startswith("pct_")})


@query(
    "l14_top_and_other",
    """
SELECT CASE WHEN rn <= 8 THEN label ELSE 'Other' END AS label, rn <= 8 AS is_label, sum(n)::BIGINT AS n,
  count(*) AS n_labels, round(sum(n) * 100.0 / (SELECT sum(n) FROM label_n), 6) AS pct
FROM (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS rn FROM label_n) GROUP BY ALL
""",
)
def l14(spark, sf):
    return op.top_and_other(counts(spark, sf)).withColumn("pct", F.round("pct", 6))


@query(
    "l15_modeling_observations",
    """
SELECT (SELECT count(*) FROM label_n) AS n_labels,
  (SELECT round(max(n) / min(n), 6) FROM label_n) AS imbalance_ratio,
  min(n_words) AS min_words, max(n_words) AS max_words, round(avg(n_words), 6) AS avg_words,
  round(avg(n_paragraphs), 6) AS avg_paragraphs, count(*) AS n_docs, sum(n_paragraphs)::BIGINT AS total_paragraphs
FROM texts
""",
)
def l15(spark, sf):
    row = op.modeling_observations(doc.with_counts(fixtures.sectioned(spark, sf)), counts(spark, sf))
    return row.withColumns({c: F.round(c, 6) for c in ("imbalance_ratio", "avg_words", "avg_paragraphs")})
