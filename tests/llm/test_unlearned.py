"""The language stage beside texts of a language that it never learned."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_unlearned_texts_go_clean_and_mixed_ones_stay(spark, small):
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").where("lang is not null and n_chars > 300").collect()]
    learned, unlearned = [r for r in rows if r["lang"] in ("en", "fr")], [r for r in rows if r["lang"] == "de"]
    english, french = ([r["text"] for r in learned if r["lang"] == l and r["n_chars"] < 3000] for l in ("en", "fr"))
    pick = random.Random(6)
    junk = [" ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9))) for _ in range(80)) for _ in range(20)]
    mixed = [f"{e}\n{f}" for e, f in zip(english, french)]
    odd = [("de", r["text"]) for r in unlearned] + [("junk", t) for t in junk] + [("mixed", t) for t in mixed]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    all_rows = [(r["doc_id"], r["text"], r["lang"], "learned", r["n_chars"]) for r in learned]
    all_rows += [(10_000 + i, t, None, kind, len(t)) for i, (kind, t) in enumerate(odd)]
    docs = spark.createDataFrame(all_rows, schema)
    out = corpus_pipeline.language_id(spark, docs, small)
    count = lambda df: {r["source"]: r["count"] for r in df.groupBy(F.col("source")).count().collect()}
    before, after = count(docs), count(out)
    assert len(mixed) > 5 and after["mixed"] == before["mixed"] and after["learned"] == before["learned"]
    assert "junk" not in after and after.get("de", 0) <= 0.05 * before["de"]
