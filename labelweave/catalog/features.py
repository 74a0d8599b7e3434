"""P: label filtering, splits, TF-IDF and the baseline model."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import block, query
from labelweave.operators import baseline as bl
from labelweave.operators import documents as doc
from labelweave.operators import features as ft
from labelweave.operators import metrics as met
from labelweave.operators import preparation as op
from labelweave.operators.labels import label_counts
from labelweave.plans.durable import stored

LEAST_DOCS = 50

block("kept_labels", f"SELECT doc_id, label FROM assigned JOIN label_n USING (label) WHERE n >= {LEAST_DOCS}")
block(
    "split_texts",
    """
SELECT doc_id, body, n_words, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, ('0x' || substr(sha256('42:' || sha256(body)), 1, 8))::BIGINT / 4294967296.0 AS u FROM texts)
WHERE n_words >= 10 AND doc_id IN (SELECT doc_id FROM kept_labels)
""",
)
block(
    "termed",
    r"""
SELECT doc_id, split, list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS grams
FROM (SELECT doc_id, split, list_filter(regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}'),
  lambda t: NOT list_contains([%s], t)) AS toks FROM split_texts)
"""
    % ", ".join("'" + w.replace("'", "''") + "'" for w in ft.english_stop_words()),
)
block("doc_terms", "SELECT doc_id, split, term, count(*) AS tf FROM (SELECT doc_id, split, unnest(grams) AS term FROM termed) GROUP BY ALL")
block("term_n", "SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM doc_terms WHERE split = 'train' GROUP BY term")
block("train_n", "SELECT count(*) AS n FROM split_texts WHERE split = 'train'")
block(
    "vocab",
    f"""
SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, tf, df, ln((1 + n) / (1 + df)) + 1 AS idf
FROM (SELECT * FROM term_n, train_n WHERE df >= 2 AND df <= 0.95::DOUBLE * n ORDER BY tf DESC, term LIMIT {ft.MAX_FEATURES})
""",
)
block(
    "term_weight",
    """
SELECT doc_id, split, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS tfidf
FROM (SELECT doc_id, split, term_id, d.tf * idf AS x FROM doc_terms d JOIN vocab USING (term))
""",
)


def counts(spark, sf):
    return label_counts(fixtures.labelled(spark, sf))


def texts(spark, sf):
    return doc.with_text(fixtures.sectioned(spark, sf)).drop("sections")


def prepared_texts(spark, sf):
    return op.prepare_texts(texts(spark, sf), fixtures.labelled(spark, sf), LEAST_DOCS)


def prepared(spark, sf):
    """(terms of all prepared documents, vocabulary of the train split)"""
    terms = ft.with_terms(prepared_texts(spark, sf))
    return terms, ft.fit_vocabulary(terms.where(F.col("split") == "train"))


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("p01_viable_labels", "SELECT label, n FROM label_n WHERE n >= 50")
def p01(spark, sf):
    return op.viable_labels(counts(spark, sf), 50)


@query(
    "p02_keep_viable",
    """
SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
FROM assigned JOIN label_n USING (label) WHERE n >= 50 GROUP BY doc_id
""",
)
def p02(spark, sf):
    kept = op.keep_viable(fixtures.labelled(spark, sf), counts(spark, sf), 50)
    return kept.select("doc_id", F.array_join(F.sort_array("labels"), ",").alias("labels"))


@query(
    "p03_encode_labels",
    """
SELECT doc_id, (SELECT count(*) FROM label_n k WHERE k.label < a.label)::INT AS label_id FROM assigned a
""",
)
def p03(spark, sf):
    return op.encode(fixtures.labelled(spark, sf), op.label_ids(counts(spark, sf)))


@query("p04_split", "SELECT doc_id, split FROM split_texts")
def p04(spark, sf):
    return prepared_texts(spark, sf).select("doc_id", "split")


@query(
    "p05_terms",
    "SELECT doc_id, len(grams)::BIGINT AS n_terms, md5(array_to_string(grams, '|')) AS terms_md5 FROM termed",
)
def p05(spark, sf):
    return ft.with_terms(prepared_texts(spark, sf)).select(
        "doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("terms_md5")
    )


@query("p06_term_statistics", "SELECT term, tf, df FROM term_n")
def p06(spark, sf):
    train = prepared_texts(spark, sf).where(F.col("split") == "train")
    return ft.term_statistics(ft.with_terms(train))


@query("p07_vocabulary", "SELECT term_id::INT AS term_id, term, tf, df FROM vocab")
def p07(spark, sf):
    return prepared(spark, sf)[1].drop("idf")


@query("p08_idf", "SELECT term, df, round(idf, 6) AS idf FROM vocab")
def p08(spark, sf):
    return r6(prepared(spark, sf)[1].select("term", "df", "idf"), "idf")


@query(
    "p09_tfidf_train",
    "SELECT doc_id, term_id::INT AS term_id, round(tfidf, 6) AS tfidf FROM term_weight WHERE split = 'train'",
)
def p09(spark, sf):
    terms, vocabulary = prepared(spark, sf)
    train = terms.where(F.col("split") == "train")
    return r6(ft.feature_rows(ft.vectorize(train, vocabulary)), "tfidf")


@query(
    "p10_tfidf_held_out",
    "SELECT doc_id, split, term_id::INT AS term_id, round(tfidf, 6) AS tfidf FROM term_weight WHERE split <> 'train'",
)
def p10(spark, sf):
    terms, vocabulary = prepared(spark, sf)
    vectors = ft.vectorize(terms.where(F.col("split") != "train"), vocabulary)
    rows = ft.exploded(vectors, "features", "doc_id", "split").withColumnRenamed("value", "tfidf")
    return r6(rows, "tfidf")


@query(
    "p11_prepared_summary",
    """
SELECT split, count(*) AS n_docs, (SELECT count(DISTINCT label) FROM kept_labels JOIN split_texts USING (doc_id)) AS n_labels,
  (SELECT count(*) FROM vocab) AS n_features
FROM split_texts GROUP BY split
""",
)
def p11(spark, sf):
    terms, vocabulary = prepared(spark, sf)
    return op.prepared_summary(terms, label_counts(terms), vocabulary)


block(
    "balance",
    """
SELECT label, count(*) AS n_pos, (SELECT n FROM train_n) - count(*) AS n_neg
FROM kept_labels JOIN split_texts USING (doc_id) WHERE split = 'train' GROUP BY label
""",
)


def train_balance(spark, sf):
    return op.label_balance(prepared_texts(spark, sf).where(F.col("split") == "train"))


@query(
    "p12_class_weights",
    """
SELECT label, n_pos, n_neg, round((n_pos + n_neg) / (2.0 * n_pos), 6) AS w_pos,
  round((n_pos + n_neg) / (2.0 * n_neg), 6) AS w_neg FROM balance
""",
)
def p12(spark, sf):
    return r6(op.class_weights(train_balance(spark, sf)), "w_pos", "w_neg")


@query(
    "p16_positive_weights",
    "SELECT label, round(least(50, greatest(1, n_neg / greatest(n_pos, 1))), 6) AS pos_weight FROM balance",
)
def p16(spark, sf):
    return r6(op.positive_weights(train_balance(spark, sf)), "pos_weight")


def fitted(spark, sf):
    """(vectors, classes, model fitted on train)"""
    vectors = ft.vectorize(*prepared(spark, sf))
    train = vectors.where(F.col("split") == "train")
    classes = label_counts(train).select("label")
    return vectors, classes, bl.fit_baseline(train, classes)


@query("p13_fit_baseline")
def p13(spark, sf):
    """Metrics on test of the model fitted on train, over the classes of all prepared documents."""
    vectors, _, model = fitted(spark, sf)
    test = bl.predict(bl.predict_proba(vectors.where(F.col("split") == "test"), model, above=0.5))
    return met.evaluate(met.tally(test, y_true="labels"), label_counts(vectors).select("label"))


@query("p13_converged", "SELECT label, n_pos, n_neg, true AS converged FROM balance WHERE n_neg > 0")
def p13c(spark, sf):
    """No component of the penalised gradient exceeds 2e-5 per document at the fitted coefficients.

    A fixed bound, a fifth of the usual stop rule of such fits, and worked out
    apart from the fit.
    """
    vectors, _, model = fitted(spark, sf)
    steep = bl.penalised_gradient(vectors.where(F.col("split") == "train"), model)
    return steep.where("n_neg > 0").select("label", "n_pos", "n_neg", (F.col("gradient") / (F.col("n_pos") + F.col("n_neg")) < 2e-5).alias("converged"))


block(
    "margin",
    """
SELECT doc_id, label, coalesce(sum(tfidf * ((term_id * 31 + idx * 17) % 200 - 100) / 50.0), 0) - 1.0 AS z
FROM (SELECT doc_id, label, idx FROM split_texts, (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM label_n))
LEFT JOIN term_weight USING (doc_id) GROUP BY doc_id, label
""",
)


def fixed_model(spark, sf, vocabulary):
    """Coefficients from a formula instead of a fit."""
    size = vocabulary.agg(F.count(F.lit(1)).cast("int")).scalar()
    ids = op.label_ids(counts(spark, sf)).withColumn("size", size)
    weight = lambda t: ((t * 31 + F.col("label_id") * 17) % 200 - 100) / F.lit(50.0)
    return ids.select(
        "label", F.lit(-1.0).alias("intercept"),
        F.transform(F.sequence(F.lit(0), F.col("size") - 1), weight).alias("weights"),
    )


def fixed_scores(spark, sf, above=None):
    terms, vocabulary = prepared(spark, sf)
    model = stored(fixed_model(spark, sf, vocabulary), "model")
    return bl.predict_proba(ft.vectorize(terms, vocabulary), model, above)


@query("p14_predict_proba", "SELECT doc_id, label, round(1 / (1 + exp(-z)), 6) AS proba FROM margin")
def p14(spark, sf):
    return r6(bl.proba_rows(fixed_scores(spark, sf)), "proba")


@query("p15_predict", "SELECT doc_id, count_if(1 / (1 + exp(-z)) > 0.5)::BIGINT AS n_predicted FROM margin GROUP BY doc_id")
def p15(spark, sf):
    return bl.predict(fixed_scores(spark, sf, above=0.5)).select("doc_id", F.size("y_pred").cast("bigint").alias("n_predicted"))


@query("p14_likely_labels", "SELECT doc_id, label, round(1 / (1 + exp(-z)), 6) AS proba FROM margin WHERE 1 / (1 + exp(-z)) > 0.7")
def p14_likely(spark, sf):
    """Only the cells above a floor, formed without the others."""
    return r6(bl.proba_rows(fixed_scores(spark, sf, above=0.7)), "proba")
