"""WARC archives: round trips, the normaliser and its index."""

import base64
import gzip
import hashlib
import zlib

import pytest

import __spark_entry__ as entry
import check
from labelweave.llm import warc


def test_query_against_sql(spark, small, con):
    df = entry.queries()["op4_warc"](spark, small)
    assert check.compare(df, con, entry.oracle_sql()["op4_warc"]) is None


def pages(spark):
    big = "x" * 3_000_000
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (4, "http://c d\n", None), (6, "u", ""),
            (7, "ü", "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n é"), (8, "http://big", big), (8, "http://big", big), (None, "n", "same"), (None, "n", "alone")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_odd_pages(spark):
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark)).collect()), key=repr)

    def row(i, html, first=None):
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        return (i, len(raw), digest, "revisit" if first is not None else "response", first)

    big = "x" * 3_000_000
    want = [row(5, "same", 3), row(3, "same"), row(9, "same", 3), row(4, ""), row(6, "", 4), row(7, "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n é"),
            row(8, big), row(8, big), row(None, "same", 3), row(None, "alone")]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages(spark).limit(0)).collect() == []


def test_small_payloads_are_always_responses(spark):
    rows = warc.round_trip(pages(spark), least=5).collect()
    assert {r["page_id"] for r in rows if r["record_type"] == "revisit"} == set()


def test_normalised_members_stand_alone_at_their_offsets(spark, small, tmp_path):
    source = spark.read.parquet(f"{small}/pages.parquet")
    raw, members = str(tmp_path / "raw"), str(tmp_path / "members")
    written = warc.write_monolithic(warc.with_first_copy(source), raw, bytes_per_file=60_000).collect()
    assert len(written) > 2
    warc.normalise(spark, raw, members).collect()
    for row in written:
        whole = zlib.decompressobj(warc.GZIP)
        with open(f"{raw}/{row['file']}", "rb") as f:
            content = whole.decompress(f.read())
        assert whole.eof and not whole.unused_data  # one stream
        with open(f"{members}/{row['file']}", "rb") as f:
            data = f.read()
        with open(f"{members}/{row['file']}.idx") as f:
            places = [tuple(map(int, line.split())) for line in f]
        records = [gzip.decompress(data[a : a + n]) for a, n in places]
        assert len(records) == row["n_records"] and b"".join(records) == content
        assert sum(n for _, n in places) == len(data) and all(r.startswith(b"WARC/1.1") for r in records)


def test_records_are_split_wherever_the_pieces_end():
    whole = [warc.record(i, f"http://h/{i}", b"abc\r\n\r\n" * i, None, "1970-01-01T00:00:00Z") for i in range(4)]
    stream = b"".join(whole)
    for size in (1, 7, 64, len(stream)):
        pieces = (stream[i : i + size] for i in range(0, len(stream), size))
        assert list(warc.split_records(pieces)) == whole
    with pytest.raises(ValueError, match="ends early"):
        list(warc.split_records(iter([stream[:-20]])))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.split_records(iter([b"HTTP/1.1 200 OK\r\n\r\n"])))
