"""H: token counts, routing, the summary cache and batched scoring."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import block, query
from labelweave.functions.text import content_key
from labelweave.functions.tokens import token_count
from labelweave.operators import documents as doc
from labelweave.operators import preparation as prep
from labelweave.operators import routing as op
from labelweave.plans.durable import run_dir, stored
from labelweave.sources import summaries as cache

LIMIT = 512
TOKEN_SQL = r"[\p{L}\p{N}_]+|[^\s\x0b\p{Z}\p{L}\p{N}_]"

block(
    "shortened",
    f"""
SELECT doc_id, body, tokens, left(body, h) || ' [...] ' || right(body, target - h) AS summary
FROM (SELECT *, floor(target * 0.7::DOUBLE)::BIGINT AS h
  FROM (SELECT doc_id, body, tokens, floor(length(body) * {LIMIT} / tokens)::BIGINT AS target
    FROM texts JOIN token_n USING (doc_id) WHERE tokens > {LIMIT}))
""",
)
block(
    "train_ids",
    """
SELECT doc_id, body, ('0x' || substr(sha256('42:' || sha256(body)), 1, 8))::BIGINT / 4294967296.0 >= 0.3 AS train
FROM texts
""",
)


def texts(spark, sf):
    return doc.with_text(fixtures.sectioned(spark, sf)).select("doc_id", "text")


def stored_texts(spark, sf):
    """Flattened once, for operators that read the text more than once."""
    return stored(texts(spark, sf), "texts")


def long_texts(spark, sf):
    return stored_texts(spark, sf).where(op.is_long(LIMIT))


def lengths(spark, sf):
    return op.analyze_lengths(texts(spark, sf), LIMIT)


@query("h01_token_count", "SELECT doc_id, tokens AS classifier, tokens - 2 AS summarizer FROM token_n")
def h01(spark, sf):
    text = F.col("text")
    return texts(spark, sf).select(
        "doc_id", token_count(text).alias("classifier"), token_count(text, specials=0).alias("summarizer")
    )


@query(
    "h02_route_by_length",
    f"""
SELECT doc_id, tokens AS token_count, tokens > {LIMIT} AS exceeds_limit,
  CASE WHEN tokens > {LIMIT} THEN 'summarize' ELSE 'direct' END AS route FROM token_n
""",
)
def h02(spark, sf):
    return lengths(spark, sf)


@query(
    "h03_length_statistics",
    f"""
SELECT count(*) AS total_docs, count_if(tokens <= {LIMIT})::BIGINT AS direct_route,
  count_if(tokens > {LIMIT})::BIGINT AS summarize_route,
  round(count_if(tokens <= {LIMIT}) * 100.0 / count(*), 6) AS direct_pct,
  round(count_if(tokens > {LIMIT}) * 100.0 / count(*), 6) AS summarize_pct,
  round(avg(tokens), 6) AS token_mean, median(tokens) AS token_median, max(tokens) AS token_max,
  {LIMIT}::BIGINT AS max_length_threshold
FROM token_n
""",
)
def h03(spark, sf):
    row = op.length_statistics(lengths(spark, sf), LIMIT)
    return row.withColumns({c: F.round(c, 6) for c in ("direct_pct", "summarize_pct", "token_mean")})


@query(
    "h04_truncate",
    rf"""
SELECT doc_id, md5(CASE WHEN len(toks) <= {LIMIT - 2} THEN body ELSE left(body,
  list_sum(list_transform(range(1, {LIMIT - 1}), lambda i: length(gaps[i]) + length(toks[i])))::BIGINT) END) AS text_md5
FROM (SELECT doc_id, body, regexp_extract_all(body, '{TOKEN_SQL}') AS toks, regexp_split_to_array(body, '{TOKEN_SQL}') AS gaps FROM texts)
""",
)
def h04(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(op.truncated(F.col("text"), LIMIT)).alias("text_md5"))


@query("h05_head_tail", "SELECT doc_id, md5(summary) AS text_md5, length(summary)::BIGINT AS n_chars FROM shortened")
def h05(spark, sf):
    long = long_texts(spark, sf).withColumn("token_count", token_count(F.col("text")))
    return op.head_tail_strategy(LIMIT)(long).select(
        "doc_id", F.md5("summary").alias("text_md5"), F.length("summary").cast("bigint").alias("n_chars")
    )


def load_toy_summarizer():
    """Stands where a neural model would be loaded."""
    return lambda batch: [f"{t[:50]}|{len(t)}|{t[-20:]}" for t in batch]


@query(
    "h06_model_strategy",
    "SELECT doc_id, left(body, 50) || '|' || length(body) || '|' || right(body, 20) AS summary FROM shortened",
)
def h06(spark, sf):
    return op.model_strategy(load_toy_summarizer)(long_texts(spark, sf)).select("doc_id", "summary")


@query("h07_content_key", "SELECT doc_id, left(sha256(body), 16) AS hash FROM texts")
def h07(spark, sf):
    return texts(spark, sf).select("doc_id", content_key(F.col("text")).alias("hash"))


def warm_cache(spark, long):
    """A cache an earlier run over the train split has left behind."""
    path = run_dir(spark, "cache")
    train = prep.split(long).where(F.col("split") == "train").drop("split")
    op.summarize_corpus(train, path, op.head_tail_strategy(LIMIT))
    return path


@query(
    "h08_cache_lookup",
    """
SELECT train AS hit, count(*) AS n_docs, count(DISTINCT body) AS n_texts
FROM train_ids JOIN shortened USING (doc_id, body) GROUP BY train
""",
)
def h08(spark, sf):
    long = long_texts(spark, sf)
    keys = op.content_keys(long)
    known = cache.read_cache(spark, warm_cache(spark, long), keys)
    hits = op.cache_hits(keys, known).select("doc_id", "hash", F.lit(True).alias("hit"))
    unknown = op.cache_misses(keys, known).select("digest")
    misses = keys.join(unknown, "digest", "left_semi").select("doc_id", "hash", F.lit(False).alias("hit"))
    return hits.unionAll(misses).groupBy("hit").agg(
        F.count(F.lit(1)).alias("n_docs"), F.countDistinct("hash").alias("n_texts")
    )


@query(
    "h09_summarize_corpus",
    """
SELECT doc_id, train AS cached, md5(summary) AS summary_md5 FROM train_ids JOIN shortened USING (doc_id)
""",
)
def h09(spark, sf):
    long = long_texts(spark, sf)
    path = warm_cache(spark, long)
    done = op.summarize_corpus(long, path, op.head_tail_strategy(LIMIT))
    return done.select("doc_id", "cached", F.md5("summary").alias("summary_md5"))


@query(
    "h10_preprocess",
    "SELECT doc_id, md5(coalesce(summary, t.body)) AS text_md5 FROM texts t LEFT JOIN shortened USING (doc_id)",
)
def h10(spark, sf):
    path = run_dir(spark, "cache")
    done = op.preprocess(stored_texts(spark, sf), path, op.head_tail_strategy(LIMIT), LIMIT)
    return done.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "h09_repeated_ids",
    """
SELECT doc_id % 7 AS doc_id, md5(summary) AS summary_md5, count(*) AS n_docs FROM shortened GROUP BY ALL
""",
)
def h09r(spark, sf):
    """Ids that repeat over different texts, without a cache."""
    long = long_texts(spark, sf).withColumn("doc_id", F.col("doc_id") % 7)
    done = op.summarize_corpus(long, None, op.head_tail_strategy(LIMIT))
    return done.groupBy("doc_id", F.md5("summary").alias("summary_md5")).agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    "h10_null_texts",
    """
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN md5(coalesce(summary, t.body)) END AS text_md5
FROM texts t LEFT JOIN shortened USING (doc_id)
""",
)
def h10n(spark, sf):
    """Every fifth text is missing and must come through as it is."""
    some = stored_texts(spark, sf).withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    done = op.preprocess(some, run_dir(spark, "cache"), op.head_tail_strategy(LIMIT), LIMIT)
    return done.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "h11_processing_counters",
    """
SELECT sum(k)::BIGINT AS total_processed, sum(k) FILTER (NOT long)::BIGINT AS direct_classified,
  sum(k) FILTER (long)::BIGINT AS summarized_first
FROM (SELECT doc_id IN (SELECT doc_id FROM shortened) AS long, CASE WHEN train THEN 2 ELSE 1 END AS k FROM train_ids)
""",
)
def h11(spark, sf):
    """Two runs added up: the train split, then the whole corpus."""
    path = run_dir(spark, "runs")
    everything = stored_texts(spark, sf)
    train = prep.split(everything).where(F.col("split") == "train")
    for name, part in (("train", train), ("all", everything)):
        op.append_run(op.route_counts(op.analyze_lengths(part, LIMIT)), path, name)
    return op.processing_totals(spark.read.parquet(path))


@query(
    "h12_cache_statistics",
    """
SELECT count(*) AS n_entries, sum(length(body))::BIGINT AS original_chars,
  sum(length(summary))::BIGINT AS summary_chars, 0::BIGINT AS n_wrong_length
FROM (SELECT DISTINCT body, summary FROM shortened)
""",
)
def h12(spark, sf):
    path = run_dir(spark, "cache")
    op.summarize_corpus(long_texts(spark, sf), path, op.head_tail_strategy(LIMIT))
    return cache.cache_statistics(cache.read_cache(spark, path))


CLASSES = ("alpha", "beta", "gamma")


def load_toy_classifier():
    """Stands where a neural model would be loaded."""
    return lambda batch: [[(len(t) * 31 + j * 17) % 1000 / 1000 for j in range(3)] for t in batch]


@query(
    "h13_score_batches",
    """
SELECT doc_id, label, (length(body) * 31 + j * 17) % 1000 / 1000 AS p
FROM texts, (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) AS v(label, j)
""",
)
def h13(spark, sf):
    scored = op.score_batches(texts(spark, sf), load_toy_classifier, CLASSES)
    return scored.select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.label", "c.p")
