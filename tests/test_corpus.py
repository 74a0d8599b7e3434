"""Sources and nested-document expressions on literals."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from labelweave.functions import nested
from labelweave.functions.text import shorten, word_count
from labelweave.functions.tokens import token_count, tokenizer_count
from labelweave.operators import documents as doc
from labelweave.sources import corpus as src
from labelweave.sources import summaries


def sections_frame(spark, schema, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"doc_id int, sections {schema}")


def measured(df):
    out = df.select(
        "doc_id", nested.extract_text(df).alias("text"), nested.extract_text(df, fallback_text=False).alias("bare"),
        nested.paragraph_count(df).alias("paragraphs"), nested.section_count(df).alias("sections"),
        nested.document_words(df).alias("words"), nested.all_sections_empty(df).alias("empty"),
    )
    return [tuple(r)[1:] for r in out.orderBy("doc_id").collect()]


def test_struct_sections_prefer_paragraphs(spark):
    df = sections_frame(
        spark, "array<struct<headtext:string,paragraphs:array<string>,text:string>>",
        [("h", ["a b", "c"], "ignored"), ("h", ["d"], None)],
        [("h", None, "only text")],
        [("h", [], "ignored")],
        [],
        [("h", ["a", None, "b"], None)],
    )
    assert measured(df) == [
        ("a b c d", "a b c d", 3, 2, 4, False),
        ("only text", "", 1, 1, 0, True),
        ("", "", 1, 1, 0, True),
        ("", "", 0, 0, 0, True),
        ("a b", "a b", 3, 1, 2, False),
    ]


def test_text_only_string_and_scalar_sections(spark):
    texts = sections_frame(spark, "array<struct<text:string>>", [("a b",), ("c",)])
    assert measured(texts) == [("a b c", "", 2, 2, 0, True)]
    strings = sections_frame(spark, "array<string>", ["a b", "c"], [])
    assert measured(strings) == [("a b c", "a b c", 2, 2, 3, False), ("", "", 0, 0, 0, True)]
    none = sections_frame(spark, "array<string>", None), sections_frame(spark, "array<struct<text:string>>", None)
    assert [df.select(nested.paragraph_count(df)).first()[0] for df in none] == [1, 1]
    scalar = sections_frame(spark, "string", "a b c")
    assert measured(scalar) == [("a b c", "a b c", 1, 0, 3, False)]
    assert scalar.select(nested.section_count(scalar, scalar_value=1)).first()[0] == 1


@pytest.mark.parametrize(
    "text", ["", "   ", "  a b\x1cc\n", "a b c", "\ta\n\nb\r\nc\x0bd ", "x\x85y　z", "één twee"]
)
def test_words_as_python_splits(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(word_count(F.col("t"))).first()
    assert row[0] == len(text.split())


def test_standardize_finds_roles_and_counts_repeats(spark):
    df = spark.createDataFrame(
        [("d1", ["b", "a", "b"], ["x y"]), ("d2", None, None)], "ID string, Labels array<string>, Sections array<string>"
    )
    assert src.detect_roles(df) == {"labels": "Labels", "text": "Sections", "id": "ID"}
    rows = src.standardize(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.labels, r.n_repeated_labels) for r in rows] == [("d1", ["b", "a"], 1), ("d2", [], 0)]


def test_role_preference_and_absence(spark):
    df = spark.createDataFrame([(1, "a", "t", "u")], "id int, label string, text string, Postures string")
    assert src.detect_roles(df)["labels"] == "Postures"
    bare = spark.createDataFrame([(1,)], "id int")
    assert src.detect_roles(bare) == {"labels": None, "text": None, "id": "id"}
    assert src.standardize(bare).first().labels == []
    with pytest.raises(ValueError):
        src.standardize(spark.createDataFrame([(1,)], "other int"))


def test_load_json_lines(spark, tmp_path):
    lines = [{"documentId": "a", "postures": ["p"], "sections": [{"headtext": "h", "paragraphs": ["one two"]}]}]
    path = tmp_path / "corpus.txt"
    path.write_text("\n".join(json.dumps(l) for l in lines))
    df = src.load_corpus(spark, str(path))
    assert src.get_column_names(df) == ["documentId", "postures", "sections", "_corrupt_record"]
    assert src.get_schema(df)["postures"] == "array<string>"
    cached = src.cached(src.standardize(df))
    assert cached.is_cached and cached.count() == 1
    cached.unpersist()
    assert doc.with_counts(src.standardize(df)).first().n_words == 2
    with pytest.raises(ValueError):
        src.load_corpus(spark, str(path), fmt="avro")


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_missing_path_fails_at_once(spark, fmt):
    with pytest.raises(AnalysisException) as e:
        src.load_corpus(spark, "/nowhere/at/all", fmt=fmt)
    assert e.value.getCondition() == "PATH_NOT_FOUND"


def test_broken_lines_are_kept_aside(spark):
    good = '  {"documentId": "a", "postures": [], "sections": []} '
    lines = spark.createDataFrame([(good,), ('{"documentId": "b"',)], "value string")
    rows = {r.documentId: r._corrupt_record for r in src.parse_lines(lines).collect()}
    assert rows["a"] is None
    assert any(v is not None for v in rows.values())


def test_loader_keeps_every_column_shape_and_line(spark, tmp_path):
    lines = [
        {"id": "a", "labels": ["p"], "sections": [{"paragraphs": ["one two", "three"]}, {"text": "four"}]},
        {"id": "b", "labels": None, "sections": ["five six", "{odd", {"headtext": "h", "paragraphs": ["seven"]}]},
        {"id": "c", "extra": 7, "sections": [{"text": "eight"}]},
    ]
    path = tmp_path / "corpus.txt"
    path.write_text("\n".join([json.dumps(lines[0]), "", json.dumps(lines[1]), '{"id": "cut', "   ", json.dumps(lines[2])]))
    df = src.load_corpus(spark, str(path))
    good, rejects = src.without_rejects(df)
    assert sorted(r[0] for r in rejects.collect()) == ["", "   ", '{"id": "cut']
    assert set(good.columns) == {"id", "labels", "sections", "extra"}
    docs = src.standardize(good)
    rows = docs.select("doc_id", nested.extract_text(docs).alias("t"), nested.paragraph_count(docs).alias("k")).collect()
    assert sorted(map(tuple, rows)) == [("a", "one two three four", 2), ("b", "five six {odd seven", 3), ("c", "eight", 1)]


def test_short_null_and_long_texts_are_all_on_one_side(spark):
    df = spark.createDataFrame([(1, None), (2, "a b"), (3, "a b c"), (4, "")], "doc_id int, text string")
    kept, rejected = doc.split_by_length(df, 3)
    assert [r.doc_id for r in kept.collect()] == [3] and sorted(r.doc_id for r in rejected.collect()) == [1, 2, 4]


def test_shorten_and_preview(spark):
    row = spark.range(1).select(shorten(F.lit("abcdef"), 3), shorten(F.lit("abc"), 3)).first()
    assert tuple(row) == ("abc...", "abc")
    df = sections_frame(spark, "array<struct<paragraphs:array<string>>>", [(["x" * 300],)], [], [([],)])
    assert [r.preview for r in doc.preview(df).orderBy("doc_id").collect()] == ["x" * 200, None, None]


def test_cache_files_one_per_entry(spark, tmp_path):
    for key in ("aa", "bb"):
        entry = {"hash": key, "original_length": 10, "summary_length": 3, "summary": "sum"}
        (tmp_path / f"{key}.json").write_text(json.dumps(entry, indent=2))
    entries = summaries.import_json(spark, str(tmp_path))
    assert sorted(r["hash"] for r in entries.collect()) == ["aa", "bb"]
    assert summaries.cache_statistics(entries).first().n_wrong_length == 0


def test_token_counts_and_real_tokenizer_slot(spark):
    df = spark.createDataFrame([("Hello, wide world!",), ("",)], "t string")

    def load():
        return lambda texts: [len(t) for t in texts]

    rows = df.select(token_count(F.col("t")).alias("a"), tokenizer_count(F.col("t"), load).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(7, 18), (2, 0)]


def test_written_folders_are_fresh_and_go_at_the_end(spark, tmp_path, monkeypatch):
    from labelweave.plans import durable

    monkeypatch.setattr(durable, "shared_root", lambda spark: str(tmp_path))
    monkeypatch.setattr(durable, "_runs", [])
    kept, gone = (durable.stored(spark.range(n), "numbers") for n in (3, 4))
    assert (kept.count(), gone.count()) == (3, 4)
    durable.discard(gone)
    assert len(list((tmp_path / "labelweave").iterdir())) == 1 and kept.count() == 3
    durable.remove_runs(spark)
    assert list((tmp_path / "labelweave").iterdir()) == []


def test_labels_and_sections_of_any_shape_in_one_file(spark, tmp_path):
    lines = [
        '{"documentId":"a","postures":["x","y",null,"x"],"sections":[{"headtext":"h","paragraphs":["one","two"]},"three",{"text":"four"},null]}',
        '{"documentId":"b","postures":"[z]","sections":"five"}', '{"documentId":"c","postures":null,"sections":[]}',
        '{"documentId":"d","sections":null}', '{"documentId":"e","postures":7,"sections":[{"paragraphs":"six"}]}', '["no object"]', "",
        '{"documentId":"f","postures":["cut"', '{"documentId":8,"postures":[],"sections":[{"other":1}]}',
    ]
    (tmp_path / "part.jsonl").write_text("\n".join(lines))
    want = {
        "a": (["x", "y"], 1, "one two three four"), "b": (["[z]"], 0, "five"), "c": ([], 0, ""), "d": ([], 0, ""), "e": (["7"], 0, "six"),
        "8": ([], 0, '{"other":1}'),
    }
    read, rejects = src.without_rejects(src.load_documents(spark, str(tmp_path)))
    got = read.select("doc_id", "labels", "n_repeated_labels", nested.extract_text(read)).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == want
    assert sorted(r[0] for r in rejects.collect()) == sorted([lines[5], "", lines[7]])
    inferred, _ = src.without_rejects(src.load_corpus(spark, str(tmp_path)))
    assert dict(inferred.dtypes)["postures"] == "variant"
    docs = src.standardize(inferred.where("documentId is not null"))
    got = docs.select("doc_id", "labels", "n_repeated_labels").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: w[:2] for i, w in want.items()}
