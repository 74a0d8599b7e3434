"""S: reading and writing the corpus, predictions, reports and the cache."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import block, query
from labelweave.functions import nested
from labelweave.operators import documents as doc
from labelweave.operators import metrics as met
from labelweave.operators import routing
from labelweave.operators.labels import label_counts, label_distribution
from labelweave.plans.durable import run_dir
from labelweave.sources import corpus as src
from labelweave.sources import predictions as pred
from labelweave.sources import reports
from labelweave.sources import summaries as cache


def as_corpus_lines(spark, sf):
    """The documents under the names and types of a corpus file."""
    return fixtures.corpus(spark, sf).select(
        F.col("doc_id").cast("string").alias("documentId"), F.col("labels").alias("postures"), "sections"
    )


def written_corpus(spark, sf):
    path = run_dir(spark, "corpus")
    as_corpus_lines(spark, sf).write.json(path)
    return path


block("mixed", "SELECT t.*, d.text AS body0 FROM texts t JOIN documents d USING (doc_id)")


def mixed_corpus(spark, sf):
    """Lines whose sections are, by turns, paragraphs, text only, plain strings and one string.

    Every eleventh line is cut off.
    """
    docs = fixtures.table(spark, sf, "documents").join(fixtures.labelled(spark, sf), "doc_id")
    lines = F.split("text", "\n")
    paragraphs = F.transform(lines, lambda l: F.struct(F.lit("h").alias("headtext"), F.split(l, r"\. ").alias("paragraphs")))
    shapes = (paragraphs, F.transform(lines, lambda l: F.struct(l.alias("text"))), lines, F.array(F.array_join(lines, " ")))
    shape = F.when(F.lit(False), "")
    for n, sections in enumerate(shapes):
        whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("DOC_ID"), F.col("labels").alias("procedural_posture"), sections.alias("Sections")))
        shape = shape.when(F.col("doc_id") % 4 == n, whole)
    cut = F.when(F.col("doc_id") % 11 == 0, F.substring(shape, F.lit(1), F.length(shape) - 3)).otherwise(shape)
    path = run_dir(spark, "mixed")
    docs.select(cut.alias("value")).write.text(path)
    return path


SUMMARY = """
SELECT doc_id::VARCHAR AS doc_id, len(labs)::BIGINT AS n_labels, n_paragraphs, md5(body) AS text_md5
FROM corpus JOIN texts USING (doc_id)
"""


def summary(docs):
    return docs.select(
        "doc_id", F.size("labels").cast("bigint").alias("n_labels"),
        nested.paragraph_count(docs).alias("n_paragraphs"), F.md5(nested.extract_text(docs)).alias("text_md5"),
    )


@query("s01_load_corpus", SUMMARY)
def s01(spark, sf):
    return summary(src.standardize(src.load_corpus(spark, written_corpus(spark, sf))))


@query("s01_load_corpus_parquet", SUMMARY)
def s01p(spark, sf):
    path = run_dir(spark, "corpus")
    as_corpus_lines(spark, sf).write.parquet(path)
    return summary(src.standardize(src.load_corpus(spark, path, fmt="parquet")))


@query(
    "s04_peek",
    """
SELECT doc_id, array_to_string(list_sort(labs), ',') AS labels FROM corpus ORDER BY doc_id LIMIT 5
""",
)
def s04(spark, sf):
    docs = src.peek(fixtures.labelled(spark, sf))
    return docs.select("doc_id", F.array_join(F.sort_array("labels"), ",").alias("labels"))


@query(
    "s06_parse_lines",
    """
SELECT len(labs) = 0 AS broken, count(*) AS n_lines, sum(n_paragraphs) FILTER (len(labs) > 0)::BIGINT AS n_paragraphs
FROM corpus JOIN texts USING (doc_id) GROUP BY broken
""",
)
def s06(spark, sf):
    """Lines of unlabelled documents are cut off and must be set aside."""
    docs = as_corpus_lines(spark, sf)
    line = F.to_json(F.struct(*docs.columns))
    cut = F.when(F.size("postures") == 0, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    path = run_dir(spark, "lines")
    docs.select(F.concat(cut, F.lit("  ")).alias("value")).write.text(path)
    parsed = src.parse_lines(spark.read.text(path))
    broken = F.col("_corrupt_record").isNotNull()
    counted = parsed.select(broken.alias("broken"), nested.paragraph_count(parsed).alias("k"))
    return counted.groupBy("broken").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(~F.col("broken"), F.col("k"))).alias("n_paragraphs")
    )


@query(
    "s01_mixed_shapes",
    """
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE n_words END AS n_words,
  CASE WHEN doc_id % 4 = 0 THEN n_paragraphs WHEN doc_id % 4 = 3 THEN 1 ELSE n_sections END::BIGINT AS n_paragraphs,
  md5(CASE WHEN doc_id % 4 = 0 THEN body ELSE replace(body0, chr(10), ' ') END) AS text_md5
FROM mixed WHERE doc_id % 11 <> 0
""",
)
def s01m(spark, sf):
    """Four shapes of sections in a corpus with its own column names, and broken lines."""
    good, _ = src.without_rejects(src.load_corpus(spark, mixed_corpus(spark, sf)))
    docs = src.standardize(good)
    return docs.select(
        "doc_id", nested.document_words(docs).alias("n_words"), nested.paragraph_count(docs).alias("n_paragraphs"),
        F.md5(nested.extract_text(docs)).alias("text_md5"),
    )


def mixed_labels(spark, sf):
    """Lines whose labels are, by turns, a list, a list that repeats its first label, one scalar, a number, null and missing.

    Sections are a list of objects, strings and text-only objects within one
    line, or one string; every thirteenth line is cut off.
    """
    docs = fixtures.table(spark, sf, "documents").join(fixtures.labelled(spark, sf), "doc_id")
    lines = F.split("text", "\n")
    first = F.array_min("labels")
    kinds = (
        F.to_json(F.struct("labels")), F.to_json(F.struct(F.concat(F.array(first), F.col("labels")).alias("labels"))),
        F.to_json(F.struct(first.alias("labels"))), F.to_json(F.struct(F.col("doc_id").alias("labels"))), F.lit('{"labels":null}'), F.lit("{}"),
    )
    own = F.when(F.lit(False), "")
    for n, kind in enumerate(kinds):
        own = own.when(F.col("doc_id") % 6 == n, kind)
    own = F.when(F.size("labels") == 0, F.lit("{}")).otherwise(own)
    element = lambda l, i: F.when(i % 3 == 0, F.to_json(F.struct(F.array(l).alias("paragraphs")))).when(
        i % 3 == 1, F.to_json(F.struct(l.alias("text")))).otherwise(F.substring(F.to_json(F.array(l)), F.lit(2), F.length(F.to_json(F.array(l))) - 2))
    whole = F.to_json(F.struct(F.array_join(lines, " ").alias("Sections")))
    listed = F.concat(F.lit('{"Sections":['), F.array_join(F.transform(lines, element), ","), F.lit("]}"))
    sections = F.when(F.col("doc_id") % 4 == 0, whole).otherwise(listed)
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    line = F.concat(F.lit('{"DOC_ID":'), F.col("doc_id"), F.lit(","), inner(sections), F.when(own != "{}", F.concat(F.lit(","), inner(own))).otherwise(""), F.lit("}"))
    path = run_dir(spark, "mixed-labels")
    docs.select(F.when(F.col("doc_id") % 13 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    return path


@query(
    "s01_mixed_labels",
    """
SELECT doc_id::VARCHAR AS doc_id,
  CASE WHEN len(labs) = 0 OR doc_id % 6 > 3 THEN '' WHEN doc_id % 6 < 2 THEN array_to_string(list_sort(labs), '|')
    WHEN doc_id % 6 = 2 THEN list_min(labs) ELSE doc_id::VARCHAR END AS labels,
  (len(labs) > 0 AND doc_id % 6 = 1)::BIGINT AS n_repeated,
  (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE len(string_split(body0, chr(10))) END)::BIGINT AS n_sections,
  md5(replace(body0, chr(10), ' ')) AS text_md5
FROM mixed JOIN corpus USING (doc_id) WHERE doc_id % 13 <> 0
""",
)
def s01ml(spark, sf):
    """Every line by its own shape, in one pass over the file."""
    docs, _ = src.without_rejects(src.load_documents(spark, mixed_labels(spark, sf)))
    return docs.select(
        "doc_id", F.array_join(F.sort_array("labels"), "|").alias("labels"), F.col("n_repeated_labels").alias("n_repeated"),
        nested.section_count(docs).alias("n_sections"), F.md5(nested.extract_text(docs)).alias("text_md5"),
    )


@query("s01_rejects", "SELECT count(*) AS n_rejects FROM documents WHERE doc_id % 11 = 0")
def s01r(spark, sf):
    _, rejects = src.without_rejects(src.load_corpus(spark, mixed_corpus(spark, sf)))
    return rejects.agg(F.count(F.lit(1)).alias("n_rejects"))


@query("s03_cached_corpus", "SELECT count(*) AS n_docs, sum(n_paragraphs)::BIGINT AS n_paragraphs FROM texts")
def s03(spark, sf):
    """The kept frame answers a second question without another scan."""
    docs = src.cached(doc.with_counts(src.standardize(src.load_corpus(spark, written_corpus(spark, sf)))))
    docs.count()
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_paragraphs").alias("n_paragraphs"))


@query(
    "s05_schema",
    """
SELECT 'documentId' AS name, 'string' AS type, count(*) AS n_filled FROM corpus
UNION ALL SELECT 'postures', 'array<string>', count(*) FROM corpus
UNION ALL SELECT 'sections', 'array<struct<headtext:string,paragraphs:array<string>>>', count(*) FROM corpus
UNION ALL SELECT '_corrupt_record', 'string', 0 FROM (SELECT count(*) FROM corpus)
""",
)
def s05(spark, sf):
    docs = src.load_corpus(spark, written_corpus(spark, sf))
    kinds = src.get_schema(docs)
    filled = docs.agg(*[F.count(c).alias(c) for c in src.get_column_names(docs)])
    listed = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("type"), F.col(c).alias("n_filled")) for c, k in kinds.items()])
    return filled.select(F.explode(listed).alias("r")).select("r.*")


@query(
    "d01_detect_roles",
    """
SELECT 'labels' AS role, 'procedural_posture' AS name, count(*) AS n_filled FROM mixed WHERE doc_id % 11 <> 0
UNION ALL SELECT 'text', 'Sections', count(*) FROM mixed WHERE doc_id % 11 <> 0
UNION ALL SELECT 'id', 'DOC_ID', count(*) FROM mixed WHERE doc_id % 11 <> 0
""",
)
def d01(spark, sf):
    good, _ = src.without_rejects(src.load_corpus(spark, mixed_corpus(spark, sf)))
    roles = src.detect_roles(good)
    filled = good.agg(*[F.count(name).alias(role) for role, name in roles.items()])
    listed = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("name"), F.col(r).alias("n_filled")) for r, n in roles.items()])
    return filled.select(F.explode(listed).alias("r")).select("r.*")


def decided(spark, sf, p, threshold):
    return fixtures.scored(spark, sf).withColumn("y_pred", met.predicted("cells", p, threshold))


@query(
    "s07_store_predictions",
    """
SELECT 'model' || m AS model, split, count(DISTINCT doc_id) AS n_docs,
  sum(CASE WHEN m = 1 THEN p1 ELSE p2 END)::BIGINT AS proba_sum,
  count_if(CASE WHEN m = 1 THEN p1 >= 500 ELSE p2 >= 600 END)::BIGINT AS n_predicted
FROM cell_p, (VALUES (1), (2)) AS v(m) GROUP BY m, split
""",
)
def s07(spark, sf):
    path = run_dir(spark, "predictions")
    models = []
    for model, p, threshold in (("model1", "p1", 500), ("model2", "p2", 600)):
        cells = F.transform("cells", lambda c: F.struct(c["label"].alias("label"), c[p].alias("p")))
        models.append(F.struct(F.lit(model).alias("model"), cells.alias("cells"), met.predicted("cells", p, threshold).alias("y_pred")))
    both = fixtures.scored(spark, sf).select("doc_id", "split", F.explode(F.array(*models)).alias("m"))
    pred.save_all(both.select("doc_id", "split", "m.*"), path)
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c["p"])
    return pred.load_predictions(spark, path).groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(total).alias("proba_sum"),
        F.sum(F.size("y_pred")).alias("n_predicted"),
    )


@query(
    "s08_label_report",
    """
SELECT 'tier:' || tier AS part, label, n FROM label_tier
UNION ALL SELECT 'modeling_subset', label, n FROM label_n WHERE n >= 50
UNION ALL SELECT 'full', label, n FROM label_n
UNION ALL SELECT 'summary', 'total_assignments', sum(n)::BIGINT FROM label_n
""",
)
def s08(spark, sf):
    report = reports.label_report(label_counts(fixtures.labelled(spark, sf)))
    path = run_dir(spark, "report")
    reports.write_report(report, path)
    stored = reports.read_report(spark, path, report.schema)
    full = stored.select(F.explode("full_distribution").alias("r")).select("r.label", "r.n")
    names = [
        *[F.struct(F.lit(f"tier:{t}").alias("part"), F.col(f"tiers.{t}").alias("labels")) for t in ("common", "moderate", "rare")],
        F.struct(F.lit("modeling_subset").alias("part"), F.col("modeling_subset").alias("labels")),
        F.struct(F.lit("full").alias("part"), F.transform("full_distribution", lambda r: r["label"]).alias("labels")),
    ]
    listed = stored.select(F.explode(F.array(*names)).alias("p")).select("p.part", F.explode("p.labels").alias("label"))
    total = stored.select(
        F.lit("summary").alias("part"), F.lit("total_assignments").alias("label"),
        F.col("summary.total_assignments").alias("n"),
    )
    return listed.join(full, "label").select("part", "label", "n").unionAll(total)


@query(
    "s09_summary_store",
    """
SELECT left(sha256(body), 16) AS hash, length(body)::BIGINT AS original_length,
  length(summary)::BIGINT AS summary_length, md5(summary) AS summary_md5
FROM (SELECT DISTINCT body, summary FROM shortened)
""",
)
def s09(spark, sf):
    """Entries exported as JSON, imported, stored and read back."""
    from labelweave.catalog.routing import LIMIT, long_texts

    first, exported, second = (run_dir(spark, n) for n in ("cache", "json", "cache"))
    routing.summarize_corpus(long_texts(spark, sf), first, routing.head_tail_strategy(LIMIT))
    cache.export_json(cache.read_cache(spark, first), exported)
    cache.append_cache(cache.import_json(spark, exported, one_per_file=False), second)
    entries = cache.read_cache(spark, second)
    return entries.select("hash", "original_length", "summary_length", F.md5("summary").alias("summary_md5"))


@query(
    "s10_stored_or_scored",
    "SELECT doc_id, count_if(p1 >= 500)::BIGINT AS n_predicted FROM cell_p WHERE split = 'test' GROUP BY doc_id",
)
def s10(spark, sf):
    """Scored and stored on the first call, only read on the second."""
    path = run_dir(spark, "predictions")
    test = decided(spark, sf, "p1", 500).where(F.col("split") == "test")

    def refuse():
        raise RuntimeError("scored although stored")

    pred.stored_or_scored(spark, path, "model1", "test", lambda: test)
    stored = pred.stored_or_scored(spark, path, "model1", "test", refuse)
    return stored.select("doc_id", F.size("y_pred").cast("bigint").alias("n_predicted"))


@query(
    "l09_stored_taxonomy",
    "SELECT label, n FROM label_n",
)
def l09s(spark, sf):
    """Counts from a corpus written as JSON lines and read back."""
    docs = src.standardize(src.load_corpus(spark, written_corpus(spark, sf)))
    return label_distribution(label_counts(docs))
