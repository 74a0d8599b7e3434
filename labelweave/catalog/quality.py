"""Q: duplicates, cohorts and length distributions."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import block, query
from labelweave.functions import nested
from labelweave.functions.text import content_digest
from labelweave.functions.tokens import token_count
from labelweave.operators import documents as doc
from labelweave.operators import quality as op

block("copies", "SELECT sha256(body) AS digest, count(*) AS n FROM texts GROUP BY digest")
block(
    "cohorts",
    "SELECT doc_id, len(labs) = 0 AS unlabelled, n_words, n_sections FROM corpus JOIN texts USING (doc_id)",
)
block(
    "token_n",
    r"SELECT doc_id, (len(regexp_extract_all(body, '[\p{L}\p{N}_]+|[^\s\x0b\p{Z}\p{L}\p{N}_]')) + 2)::BIGINT AS tokens FROM texts",
)


def texts(spark, sf):
    return doc.with_text(fixtures.sectioned(spark, sf)).select("doc_id", "text")


def word_values(spark, sf):
    return op.value_counts(doc.with_counts(fixtures.sectioned(spark, sf)), "n_words")


def token_values(spark, sf):
    counted = texts(spark, sf).select(token_count(F.col("text")).alias("tokens"))
    return op.value_counts(counted, "tokens")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def cohorts(spark, sf):
    """(doc_id, labels, counts): measured first, so only narrow rows meet the labels."""
    counted = doc.with_counts(fixtures.sectioned(spark, sf))
    return counted.join(fixtures.labelled(spark, sf), "doc_id")


def unlabelled():
    return F.size("labels") == 0


@query(
    "q01_exact_duplicates",
    """
SELECT sum(n)::BIGINT AS n_docs, (SELECT count(DISTINCT doc_id) FROM texts) AS n_ids, count(*) AS n_texts,
  count_if(n > 1)::BIGINT AS n_repeated_texts,
  coalesce(sum(n) FILTER (n > 1) - count_if(n > 1), 0)::BIGINT AS n_extra_copies
FROM copies
""",
)
def q01(spark, sf):
    return op.duplicate_summary(texts(spark, sf))


@query("q02_duplicate_histogram", "SELECT n AS copies, count(*) AS n_texts FROM copies WHERE n > 1 GROUP BY n")
def q02(spark, sf):
    return op.duplicate_histogram(texts(spark, sf))


@query(
    "q03_duplicate_label_consistency",
    """
SELECT count_if(v = 1)::BIGINT AS n_consistent, count_if(v > 1)::BIGINT AS n_inconsistent FROM (
  SELECT body, count(DISTINCT list_sort(labs)) AS v FROM corpus JOIN texts USING (doc_id)
  GROUP BY body HAVING count(*) > 1)
""",
)
def q03(spark, sf):
    digests = texts(spark, sf).select("doc_id", content_digest(F.col("text")).alias("digest"))
    return op.duplicate_label_consistency(digests.join(fixtures.labelled(spark, sf), "doc_id"))


@query(
    "q04_cohort_profile",
    """
SELECT unlabelled, count(*) AS n_docs, round(avg(n_sections), 6) AS avg_sections,
  round(avg(n_words), 6) AS avg_words, min(n_words) AS min_words, max(n_words) AS max_words,
  median(n_words) AS median_words
FROM cohorts GROUP BY unlabelled
""",
)
def q04(spark, sf):
    counted = cohorts(spark, sf)
    profile = op.cohort_profile(counted, unlabelled()).withColumnRenamed("cohort", "unlabelled")
    return rounded(profile, "avg_sections", "avg_words")


T_SQL = """
SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, n1 + n2 - 2 AS dof,
  round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t
FROM (SELECT count(*) FILTER (unlabelled) AS n1, count(*) FILTER (NOT unlabelled) AS n2,
  avg({0}) FILTER (unlabelled) AS m1, avg({0}) FILTER (NOT unlabelled) AS m2,
  var_samp({0}) FILTER (unlabelled) AS v1, var_samp({0}) FILTER (NOT unlabelled) AS v2 FROM cohorts)
"""


@query("q05_t_test_words", T_SQL.format("n_words"))
def q05w(spark, sf):
    counted = cohorts(spark, sf)
    return rounded(op.t_test(counted, F.col("n_words"), unlabelled()), "mean1", "mean2", "t")


@query("q05_t_test_sections", T_SQL.format("n_sections"))
def q05s(spark, sf):
    counted = cohorts(spark, sf)
    return rounded(op.t_test(counted, F.col("n_sections"), unlabelled()), "mean1", "mean2", "t")


# Twice the density's integral beyond |t|, by Simpson's rule on 20,000 steps up to |t|.
P_SQL = """
SELECT measure, dof, round(t, 6) AS t, round(1 - 2 * least(0.5, abs(t) / 20000 / 3 * (SELECT sum(
    (CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
    exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0) - 0.5 * ln(dof * pi())
      - (dof + 1) / 2.0 * ln(1 + (i * abs(t) / 20000) ** 2 / dof)))
  FROM (SELECT unnest(range(20001)) AS i))), 6) AS p_value
FROM (SELECT measure, n1 + n2 - 2 AS dof, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t
  FROM (SELECT measure, count(*) FILTER (unlabelled) AS n1, count(*) FILTER (NOT unlabelled) AS n2,
    avg(x) FILTER (unlabelled) AS m1, avg(x) FILTER (NOT unlabelled) AS m2,
    var_samp(x) FILTER (unlabelled) AS v1, var_samp(x) FILTER (NOT unlabelled) AS v2
    FROM (SELECT 'n_words' AS measure, unlabelled, n_words AS x FROM cohorts
      UNION ALL SELECT 'n_sections', unlabelled, n_sections FROM cohorts) GROUP BY measure))
"""


@query("q05_t_test_p_values", P_SQL)
def q05p(spark, sf):
    counted = cohorts(spark, sf)
    tests = [
        op.t_test(counted, F.col(c), unlabelled()).withColumn("measure", F.lit(c))
        for c in ("n_words", "n_sections")
    ]
    found = op.with_p_value(tests[0].unionByName(tests[1]))
    return rounded(found.select("measure", "dof", "t", "p_value"), "t", "p_value")


@query(
    "q06_cohort_anomalies",
    """
SELECT count_if(n_words < 10)::BIGINT AS n_short, count_if(n_sections = 0)::BIGINT AS n_without_sections,
  0::BIGINT AS n_empty_sections
FROM cohorts WHERE unlabelled
""",
)
def q06(spark, sf):
    docs = fixtures.sectioned(spark, sf)
    counted = doc.with_counts(docs.withColumn("sections_empty", nested.all_sections_empty(docs)))
    return op.anomaly_counts(counted.join(fixtures.labelled(spark, sf), "doc_id").where(unlabelled()))


HISTOGRAM_SQL = """
SELECT bin, round(lo + bin * (hi - lo) / {bins}, 6) AS low, round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS high,
  coalesce(n, 0) AS n
FROM (SELECT min({col}) AS lo, max({col}) AS hi FROM {src}), (SELECT unnest(range({bins})) AS bin)
LEFT JOIN (SELECT least((({col} - (SELECT min({col}) FROM {src})) * {bins}) //
    (SELECT max({col}) - min({col}) FROM {src}), {bins} - 1) AS bin, count(*) AS n FROM {src} GROUP BY 1) USING (bin)
"""


@query("q07_length_histogram", HISTOGRAM_SQL.format(bins=50, col="n_words", src="texts"))
def q07(spark, sf):
    return rounded(op.histogram(word_values(spark, sf)), "low", "high")


@query(
    "q07_length_summary",
    """
SELECT count(*) AS n_docs, round(avg(n_words), 6) AS mean, median(n_words) AS median, min(n_words) AS min,
  max(n_words) AS max FROM texts
""",
)
def q07s(spark, sf):
    return rounded(op.length_summary(word_values(spark, sf)), "mean")


@query(
    "q08_window_coverage",
    """
SELECT w::BIGINT AS "window", count_if(tokens <= w)::BIGINT AS n_docs,
  round(count_if(tokens <= w) * 100.0 / count(*), 6) AS pct
FROM token_n, (SELECT unnest([512, 1024, 2048, 4096, 16384]) AS w) GROUP BY w
""",
)
def q08(spark, sf):
    return rounded(op.window_coverage(token_values(spark, sf), (512, 1024, 2048, 4096, 16384)), "pct")


@query(
    "q09_cumulative_lengths",
    """
SELECT tokens AS value, n, cumulative, round(cumulative * 100.0 / (SELECT count(*) FROM token_n), 6) AS pct FROM (
  SELECT tokens, n, sum(n) OVER (ORDER BY tokens)::BIGINT AS cumulative
  FROM (SELECT tokens, count(*) AS n FROM token_n GROUP BY tokens))
""",
)
def q09(spark, sf):
    return rounded(op.cumulative_distribution(token_values(spark, sf)), "pct")
