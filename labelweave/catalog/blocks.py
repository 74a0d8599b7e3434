"""The derived corpora of ``labelweave.fixtures``, written in SQL."""

from labelweave.catalog.registry import block

block(
    "corpus",
    r"""
SELECT d.doc_id, list_filter([
    CASE WHEN d.doc_id % 20 <> 0 THEN 'lang:' || d.lang END,
    CASE WHEN d.doc_id % 2 = 1 THEN 'src:' || d.source END,
    CASE WHEN l.quality = 1 THEN 'q:hi' END,
    CASE WHEN l.quality = 0 THEN 'q:lo' END,
    CASE WHEN l.toxic = 1 THEN 'toxic' END,
    CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'q:lo:toxic' END,
    CASE WHEN d.doc_id % 50 = 7 THEN 'rare:' || ((d.doc_id // 50) % 9) END
  ], lambda x: x IS NOT NULL) AS labs
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
)

block("assigned", "SELECT doc_id, unnest(labs) AS label FROM corpus")

block("label_n", "SELECT label, count(*) AS n FROM assigned GROUP BY label")

block(
    "texts",
    r"""
SELECT doc_id, body, len(string_split(body0, chr(10))) AS n_sections,
  list_sum(list_transform(string_split(body0, chr(10)), lambda l: len(string_split(l, '. '))))::BIGINT AS n_paragraphs,
  len(list_filter(regexp_split_to_array(body, '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), lambda w: w <> ''))::BIGINT AS n_words
FROM (SELECT doc_id, text AS body0, replace(replace(text, '. ', ' '), chr(10), ' ') AS body FROM documents)
""",
)

# Orders as documents, part brands as labels.
block(
    "basket_labels",
    """
SELECT DISTINCT l_orderkey AS doc_id, p_brand AS label
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
)
block("basket_n", "SELECT label, count(*) AS n FROM basket_labels GROUP BY label")
