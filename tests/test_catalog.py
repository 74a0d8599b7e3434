"""Every registered query against its SQL twin, on the smallest data."""

import re

import pytest

import __spark_entry__ as entry
import check

# The queries of the llm subpackage have their own tests.
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.LLM_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con(small):
    return check.oracle_connection(small)


# Queries that run plug-in models or the fitted baseline in Python workers.
WITH_PYTHON = {"h06_model_strategy", "h13_score_batches", "p13_converged", "p14_predict_proba", "p15_predict", "q05_t_test_p_values"}
PRODUCTS = r"CartesianProduct|BroadcastNestedLoopJoin"
PYTHON = r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(PRODUCTS, plan)
    assert bool(re.search(PYTHON, plan)) == (name in WITH_PYTHON)
    assert check.compare(df, con, ORACLES[name]) is None


NARROW = ("d10_preview_unlabelled", "q03_duplicate_label_consistency", "q04_cohort_profile", "q05_t_test_words", "q05_t_test_sections", "q06_cohort_anomalies")


@pytest.mark.parametrize("name", NARROW)
def test_no_exchange_carries_text(spark, small, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        execution = QUERIES[name](spark, small)._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = execution.explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    nodes = re.findall(r"\(\d+\) (\w+)\n(?:Input|Output) \[\d+\]: \[([^\n]*)\]", plan)
    shuffled = [columns for node, columns in nodes if node == "Exchange"]
    assert shuffled and not any(re.search(r"\b(text|sections)#", columns) for columns in shuffled)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(set(QUERIES) - set(ORACLES)) == ["p13_fit_baseline"]


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "n", "share", "tier", "singleton"]
    assert df.count() > 0
