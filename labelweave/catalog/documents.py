"""D: per-document projections and filters. S: sources and sinks."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import query
from labelweave.functions import nested
from labelweave.functions.text import shorten
from labelweave.operators import documents as op
from labelweave.operators import labels as lab
from labelweave.sources import corpus as src


@query(
    "d02_extract_text",
    "SELECT doc_id, md5(body) AS text_md5, length(body)::BIGINT AS n_chars FROM texts",
)
def d02(spark, sf):
    docs = fixtures.sectioned(spark, sf)
    text = nested.extract_text(docs)
    return docs.select("doc_id", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("n_chars"))


@query(
    "d03_extract_all",
    "SELECT doc_id, left(body, 60) AS head, right(body, 20) AS tail, n_words FROM texts",
)
def d03(spark, sf):
    docs = op.with_text(fixtures.sectioned(spark, sf))
    return docs.select(
        "doc_id",
        F.substring("text", 1, 60).alias("head"),
        F.right("text", F.lit(20)).alias("tail"),
        nested.document_words(docs).alias("n_words"),
    )


@query(
    "d04_extract_paragraphs_only",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5('') ELSE md5(body) END AS text_md5
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS body FROM documents)
""",
)
def d04(spark, sf):
    """Every third document keeps its lines in ``text`` instead of paragraphs."""
    lines = F.split("text", "\n")
    bare = F.col("doc_id") % 3 == 0
    docs = fixtures.table(spark, sf, "documents").select(
        "doc_id",
        F.transform(
            lines,
            lambda l: F.struct(
                F.when(~bare, F.array(l)).alias("paragraphs"), F.when(bare, l).alias("text")
            ),
        ).alias("sections"),
    )
    return docs.select("doc_id", F.md5(nested.extract_text(docs, fallback_text=False)).alias("text_md5"))


@query("d05_paragraph_count", "SELECT doc_id, n_paragraphs FROM texts")
def d05(spark, sf):
    docs = fixtures.sectioned(spark, sf)
    return docs.select("doc_id", nested.paragraph_count(docs).alias("n_paragraphs"))


@query("d06_word_count", "SELECT doc_id, n_words FROM texts")
def d06(spark, sf):
    docs = fixtures.sectioned(spark, sf)
    return docs.select("doc_id", nested.document_words(docs).alias("n_words"))


@query("d07_section_count", "SELECT doc_id, n_sections::BIGINT AS n_sections FROM texts")
def d07(spark, sf):
    docs = fixtures.sectioned(spark, sf)
    return docs.select("doc_id", nested.section_count(docs).alias("n_sections"))


@query(
    "d08_minimum_words_filter",
    """
SELECT CASE WHEN n_words >= 10 THEN 'kept' ELSE 'rejected' END AS side, count(*) AS n_docs,
  sum(n_words)::BIGINT AS n_words
FROM texts GROUP BY side
""",
)
def d08(spark, sf):
    kept, rejected = op.split_by_length(op.with_text(fixtures.sectioned(spark, sf)))
    sides = [f.select(F.lit(n).alias("side"), "n_words") for f, n in ((kept, "kept"), (rejected, "rejected"))]
    return (
        sides[0].unionAll(sides[1]).groupBy("side")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))
    )


@query("d09_minimal_text", "SELECT doc_id FROM texts WHERE n_words < 10")
def d09(spark, sf):
    return op.minimal_text(fixtures.sectioned(spark, sf))


@query(
    "d10_preview_unlabelled",
    """
SELECT c.doc_id, n_sections::BIGINT AS n_sections,
  left(string_split(string_split(d.text, chr(10))[1], '. ')[1], 200) AS preview
FROM corpus c JOIN documents d USING (doc_id) JOIN texts t USING (doc_id)
WHERE len(labs) = 0 ORDER BY c.doc_id LIMIT 3
""",
)
def d10(spark, sf):
    chosen = fixtures.labelled(spark, sf).where(F.size("labels") == 0).orderBy("doc_id").limit(3)
    return op.preview(fixtures.sectioned(spark, sf).join(F.broadcast(chosen.select("doc_id")), "doc_id"))  # three ids


@query(
    "d11_label_coercion",
    """
SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END::BIGINT AS n_labels
FROM documents LEFT JOIN labels USING (doc_id)
""",
)
def d11(spark, sf):
    """A scalar, often missing label column read as label lists."""
    docs = fixtures.table(spark, sf, "documents").select("doc_id", F.col("text").alias("sections"))
    marks = fixtures.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    joined = src.standardize(docs.join(marks, "doc_id", "left"))
    return joined.select("doc_id", F.size("labels").cast("bigint").alias("n_labels"))


@query(
    "d12_shorten_labels",
    """
SELECT label, CASE WHEN length(label) > 7 THEN left(label, 7) || '...' ELSE label END AS short, n FROM label_n
""",
)
def d12(spark, sf):
    counts = lab.label_counts(fixtures.labelled(spark, sf))
    return counts.select("label", shorten(F.col("label"), 7).alias("short"), "n")


@query("d13_ranked_labels", "SELECT row_number() OVER (ORDER BY label) AS rank, label FROM label_n")
def d13(spark, sf):
    return lab.ranked_labels(lab.label_counts(fixtures.labelled(spark, sf)))
