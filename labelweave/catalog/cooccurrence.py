"""C: label pairs, conditionals and hierarchy hints."""

from pyspark.sql import functions as F

from labelweave import fixtures
from labelweave.catalog.registry import block, query
from labelweave.operators import cooccurrence as op
from labelweave.operators.labels import label_sets

block(
    "pair_n",
    """
SELECT x.label AS a, y.label AS b, count(*) AS n FROM assigned x JOIN assigned y
ON x.doc_id = y.doc_id AND x.label < y.label GROUP BY a, b
""",
)
block(
    "basket_pair_n",
    """
SELECT x.label AS a, y.label AS b, count(*) AS n FROM basket_labels x JOIN basket_labels y
ON x.doc_id = y.doc_id AND x.label < y.label GROUP BY a, b
""",
)
block(
    "directed_n",
    """
SELECT given, other, m.n AS n_given, d.n AS n, d.n / m.n AS p
FROM (SELECT a AS given, b AS other, n FROM pair_n UNION ALL SELECT b, a, n FROM pair_n) d
JOIN label_n m ON m.label = given
""",
)
block(
    "rare_company",
    """
SELECT r.label, r.n, min(len(c.labs)) > 1 AS never_alone,
  min(len(c.labs)) > 1 AND bool_and(EXISTS (SELECT 1 FROM assigned o JOIN label_n k ON k.label = o.label
    WHERE o.doc_id = c.doc_id AND o.label <> r.label AND k.n >= 100)) AS always_with_common
FROM label_n r JOIN assigned s ON s.label = r.label JOIN corpus c ON c.doc_id = s.doc_id
WHERE r.n < 50 GROUP BY r.label, r.n
""",
)
block("relations", """
SELECT * FROM (VALUES ('q:lo:toxic', 'q:lo', 'is_a'), ('toxic', 'lang:en', 'requires'),
  ('absent:label', 'q:lo', 'is_a')) AS v(child, parent, kind)
""")
block(
    "prefix_n",
    """
SELECT s.label AS short, l.label AS long, s.n AS n_short, l.n AS n_long
FROM label_n s JOIN label_n l ON starts_with(l.label, s.label) AND length(l.label) > length(s.label) + 3
""",
)

RELATIONS = (
    ("q:lo:toxic", "q:lo", "is_a"),
    ("toxic", "lang:en", "requires"),
    ("absent:label", "q:lo", "is_a"),
)


def sets(spark, sf):
    return label_sets(fixtures.labelled(spark, sf))


def directed(spark, sf):
    s = sets(spark, sf)
    return op.directed_conditionals(op.pair_counts(s), op.set_label_counts(s))


def p6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns or ("p",)})


@query("c01_pair_counts", "SELECT a, b, n FROM pair_n")
def c01(spark, sf):
    return op.pair_counts(sets(spark, sf))


@query("c01_pair_counts_baskets", "SELECT a, b, n FROM basket_pair_n")
def c01b(spark, sf):
    return op.pair_counts(label_sets(fixtures.baskets(spark, sf)))


@query(
    "c01_frequent_pairs_long_list",
    """
WITH listed AS (
  SELECT DISTINCT l_orderkey AS doc_id, 'p:' || l_partkey AS label FROM lineitem
  UNION ALL SELECT DISTINCT -1, 'p:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT -1, 'o:' || o_orderkey FROM orders)
SELECT x.label AS a, y.label AS b, count(*) AS n FROM listed x JOIN listed y
ON x.doc_id = y.doc_id AND x.label < y.label AND starts_with(x.label, 'p:') GROUP BY a, b HAVING count(*) >= 3
""",
)
def c01c(spark, sf):
    return op.frequent_pairs(label_sets(fixtures.catalogue(spark, sf)), 3)


@query("c02_top_pairs", "SELECT a, b, n FROM pair_n ORDER BY n DESC, a, b LIMIT 20")
def c02(spark, sf):
    return op.top_pairs(op.pair_counts(sets(spark, sf)))


@query(
    "c03_top_pair_conditionals",
    """
SELECT t.a, t.b, t.n, x.n AS n_a, y.n AS n_b, round(t.n / x.n, 6) AS p_b_given_a, round(t.n / y.n, 6) AS p_a_given_b
FROM (SELECT * FROM pair_n ORDER BY n DESC, a, b LIMIT 20) t
JOIN label_n x ON x.label = t.a JOIN label_n y ON y.label = t.b
""",
)
def c03(spark, sf):
    s = sets(spark, sf)
    top = op.top_pairs(op.pair_counts(s))
    return p6(op.with_conditionals(top, op.set_label_counts(s)), "p_b_given_a", "p_a_given_b")


@query(
    "c04_high_conditionals",
    """
SELECT given, other, n_given, n, round(p, 6) AS p FROM directed_n WHERE n_given >= 10 AND p > 0.8
ORDER BY directed_n.p DESC, given, other LIMIT 30
""",
)
def c04(spark, sf):
    return p6(op.strong_conditionals(sets(spark, sf)))


@query(
    "c04_high_conditionals_baskets",
    """
SELECT given, other, m.n AS n_given, d.n AS n, round(d.n / m.n, 6) AS p
FROM (SELECT a AS given, b AS other, n FROM basket_pair_n UNION ALL SELECT b, a, n FROM basket_pair_n) d
JOIN basket_n m ON m.label = given WHERE m.n >= 10 AND d.n / m.n > 0.16
ORDER BY d.n / m.n DESC, given, other LIMIT 30
""",
)
def c04b(spark, sf):
    s = label_sets(fixtures.baskets(spark, sf))
    both = op.directed_conditionals(op.pair_counts(s), op.set_label_counts(s))
    return p6(op.high_conditionals(both, min_p=0.16))


@query(
    "c05_rare_dependencies",
    """
SELECT given, other, n, n_given, round(p, 6) AS p FROM (
  SELECT *, row_number() OVER (PARTITION BY given ORDER BY n DESC, other) AS rn FROM directed_n
  WHERE n_given < 50 AND other IN (SELECT label FROM label_n WHERE n >= 100))
WHERE rn <= 3 AND p > 0.8
""",
)
def c05(spark, sf):
    s = sets(spark, sf)
    return p6(op.rare_dependencies(op.pair_counts(s), op.set_label_counts(s)))


@query("c06_prefix_pairs", "SELECT short, long, n_short, n_long FROM prefix_n")
def c06(spark, sf):
    return op.prefix_pairs(op.set_label_counts(sets(spark, sf)))


@query(
    "c07_top_matrix",
    """
SELECT x.label AS a, y.label AS b, coalesce(p.n, 0) AS n
FROM (SELECT label FROM label_n ORDER BY n DESC, label LIMIT 15) x,
  (SELECT label FROM label_n ORDER BY n DESC, label LIMIT 15) y
LEFT JOIN pair_n p ON p.a = least(x.label, y.label) AND p.b = greatest(x.label, y.label)
""",
)
def c07(spark, sf):
    s = sets(spark, sf)
    return op.top_matrix(s, op.set_label_counts(s))


@query("c08_rare_companionship", "SELECT * FROM rare_company")
def c08(spark, sf):
    s = sets(spark, sf)
    return op.rare_companionship(s, op.set_label_counts(s))


@query(
    "c09_relation_check",
    """
SELECT child, parent, kind, n_child, n_both, round(rate, 6) AS rate,
  CASE WHEN rate > 0.9 THEN 'CONFIRMED' WHEN rate > 0.5 THEN 'PARTIAL' ELSE 'NOT CONFIRMED' END AS status
FROM (SELECT child, parent, kind, count(doc_id) AS n_child,
    coalesce(count_if(list_contains(labs, parent)), 0)::BIGINT AS n_both, coalesce(n_both / nullif(n_child, 0), 0) AS rate
  FROM relations LEFT JOIN corpus ON list_contains(labs, child) GROUP BY child, parent, kind)
""",
)
def c09(spark, sf):
    return p6(op.relation_check(sets(spark, sf), op.relation_frame(spark, RELATIONS)), "rate")


@query(
    "c10_companions",
    """
SELECT other AS stage, given AS label, n_given, n, round(p, 6) AS p, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY other ORDER BY p DESC, given) AS rn FROM directed_n
  WHERE other IN ('q:hi', 'q:lo', 'lang:en') AND n_given >= 10 AND p > 0.6)
WHERE rn <= 15
""",
)
def c10(spark, sf):
    return p6(op.companions(directed(spark, sf), ("q:hi", "q:lo", "lang:en"), min_p=0.6))


@query(
    "c11_family_matrix",
    """
SELECT given, other, n_given, n, round(p, 6) AS p FROM directed_n
WHERE given IN ('q:lo', 'q:hi', 'toxic', 'q:lo:toxic') AND other IN ('q:lo', 'q:hi', 'toxic', 'q:lo:toxic')
""",
)
def c11(spark, sf):
    return p6(op.family_matrix(directed(spark, sf), ("q:lo", "q:hi", "toxic", "q:lo:toxic")))


@query(
    "c12_overlap_summary",
    """
SELECT count_if(len(labs) = 1)::BIGINT AS n_single, count_if(len(labs) > 1)::BIGINT AS n_multi,
  (SELECT count(*) FROM pair_n) AS n_pairs, (SELECT max(n) FROM pair_n) AS top_pair,
  (SELECT count(*) FROM prefix_n) AS n_prefix,
  (SELECT count_if(never_alone)::BIGINT FROM rare_company) AS n_never_alone,
  (SELECT count_if(always_with_common)::BIGINT FROM rare_company) AS n_always_with_common
FROM corpus
""",
)
def c12(spark, sf):
    return op.overlap_summary(sets(spark, sf))
