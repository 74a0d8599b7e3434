"""The corpus pipeline, stage by stage against plain counterparts."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from labelweave.llm import grading, language, secrets
from plain import roots
from test_nearcopies import alike, plain_shingles
from test_tokens import packed_rightly


def test_stages_and_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before)
        if number == 0:
            judged = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs)).collect()}
            assert set(after) == {i for i, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= 0.3}
        elif number == 1:
            rated = grading.ratings(spark.read.parquet(f"{small}/labels.parquet"))
            judged = grading.grade(docs, grading.fit(docs, rated)).collect()
            assert set(after) == {r["doc_id"] for r in judged if r["tail_probability"] >= 0.5}
        elif number == 2:
            sets = {i: plain_shingles(r["text"]) for i, r in before.items()}
            groups = roots(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
            assert set(after) == set(groups.values())
        else:
            models = secrets.train(docs)
            assert {i: r["text"] for i, r in after.items()} == {i: secrets.redacted(r["text"], models) for i, r in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if number < 3:
            assert all(after[i] == before[i] for i in after)
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    expected = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = [r.asDict() for r in entry.queries()["pipeline"](spark, small).collect()]
    packed_rightly(rows, expected, 1024)


def test_stages_on_odd_rows(spark, odd, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns and out.count() <= odd.count()
        assert stage(spark, odd.limit(0), small).collect() == []
    assert corpus_pipeline.pack(spark, odd.limit(0), small).collect() == []


def test_stages_bound_the_bytes_of_a_batch(spark, small):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([[batch.nbytes], [batch.num_rows]], names=["size", "n"])

    for name, stage in corpus_pipeline.STAGES:
        own = spark.newSession()
        docs = own.range(0, 6000, 1, 1).selectExpr("id doc_id", "repeat('some words ', 200) text", "'en' lang", "'x' source", "2200L n_chars")
        stage(own, docs.limit(0), small)
        got = docs.mapInArrow(sizes, "size long, n long").agg(F.max("size"), F.sum("n")).first()
        assert got[0] <= corpus_pipeline.MOST_BATCH_BYTES + 5000 and got[1] == 6000, name


def test_stages_keep_a_bound_that_is_set(spark, odd, small):
    own = spark.newSession()
    own.conf.set(corpus_pipeline.BATCH_BYTES, 12345)
    corpus_pipeline.pack(own, odd, small)
    assert own.conf.get(corpus_pipeline.BATCH_BYTES) == "12345"
