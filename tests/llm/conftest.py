import pytest

import check


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def con(small):
    return check.oracle_connection(small)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, one word, other scripts, and a clashing column."""
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "the same words here and there"), (6, "the same words here and there"),
        (7, "ein sehr langer Text " * 20_000), (8, "日本語の文章と emoji 😀 und ß"), (5, "the same words here and there"),
        (None, "a row without an id"), (None, None), (9, "a  b   c \n d e ▁ <|endoftext|>"), (10, "7 8 9"),
    ]
    return spark.createDataFrame([(i, t, "en" if i != 4 else None, "x", 0, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")
