"""Packing and token files against the tokenizers library on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from labelweave.llm import packing, tokenfile, tokens
from labelweave.llm.queries import BYTE_BPE


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


PARTS = st.sampled_from([" ", "  ", "\n", "\t", " \n ", " ", "a", "word", "It's", "don't", "é", "日本", "😀", "12", "3.5", "!?", "\x1c", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_pieces_give_the_ids_of_the_whole_text(whole, text):
    found = ENCODER.encode([text, "x " + text])
    assert [np.frombuffer(f, dtype="<u4").tolist() for f in found] == [whole(text), whole("x " + text)]


ENCODER = tokens.Encoder(BYTE_BPE, together=3)


def packed_rightly(pieces, expected, window):
    """Every id in exactly one piece, sequences gapless and within the window."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(expected)
    for doc_id, ids in expected.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return len(by_sequence)


def test_packing_query(spark, small, texts, whole):
    rows = [r.asDict() for r in entry.queries()["op7_packing"](spark, small).collect()]
    expected = {i: [*whole(t), 0] for i, t in texts.items()}
    n = packed_rightly(rows, expected, 1024)
    total = sum(map(len, expected.values()))
    assert 1024 * n < 1.02 * total + 2048


@settings(deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing_is_that_of_a_plain_search(sizes):
    free = []
    want = [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
        b = min(fitting)[1] if fitting else len(free)
        if not fitting:
            free.append(64)
        want[i] = (free[b], sizes[i])
        free[b] -= sizes[i]
    got = packing.best_fit_decreasing(sizes, 64)
    assert sorted((64 - offset, s) for (_, offset), s in zip(got, sizes)) == sorted(want)
    assert len({b for b, _ in got}) == len(free)


def test_packing_of_odd_rows(spark, odd, whole):
    pieces = packing.pack(odd, BYTE_BPE, end_id=0, window=64, together=4).collect()
    total = sum(len(whole(r["text"] or "")) + 1 for r in odd.collect())
    assert sum(p["length"] for p in pieces) == total
    used = defaultdict(list)
    for p in pieces:
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in used.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack(odd.limit(0), BYTE_BPE).collect() == []


def test_token_file_query(spark, small, texts, whole):
    rows = {r["doc_id"]: r for r in entry.queries()["op5_token_files"](spark, small).collect()}
    at = 0
    assert len(rows) == len(texts)
    for doc_id in sorted(texts):
        ids = [*whole(texts[doc_id]), 2]
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_of_odd_rows(spark, odd, whole):
    layout = {"length": 16, "ids_per_file": 100, "rows_per_batch": 3}
    rows = tokenfile.round_trip(odd, BYTE_BPE, 2, **layout).orderBy("start").collect()
    order = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    at = 0
    for r, source in zip(rows, order, strict=True):
        ids = [*whole(source["text"] or ""), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (source["doc_id"], at, len(ids), crc(ids))
        at += len(ids)
    assert tokenfile.round_trip(odd.limit(0), BYTE_BPE).collect() == []


def test_sequences_are_read_without_copying(spark, docs, tmp_path, whole, texts):
    manifest = tokenfile.write(docs, str(tmp_path), BYTE_BPE, length=128, rows_per_batch=7).orderBy("file").collect()
    everything = [i for d in sorted(texts) for i in [*whole(texts[d]), 2]]
    at = 0
    for entry_row in manifest:
        with pa.memory_map(str(tmp_path / entry_row["file"])) as source:
            file = tokenfile.Sequences(source)
            before = pa.total_allocated_bytes()
            for i in (0, entry_row["n_ids"] // 128 - 1):
                ids, start = file.ids(i), at + i * 128
                assert ids.tolist() == everything[start : start + 128] and file.mask(i).false_count == 0
            last = entry_row["n_ids"] // 128
            if entry_row["n_ids"] % 128:
                assert file.mask(last).true_count == entry_row["n_ids"] % 128
            assert pa.total_allocated_bytes() - before < 4096
            assert ids.dtype == np.uint16
            # A span may cross sequences and batches of seven.
            for start, stop in ((0, 1), (100, 300), (890, 900), (5, entry_row["n_ids"])):
                assert file.span(start, min(stop, entry_row["n_ids"])).tolist() == everything[at + start : at + min(stop, entry_row["n_ids"])]
        at += entry_row["n_ids"]
    assert at == len(everything)


def test_every_doc_id_is_kept(spark, whole):
    ids = [-(2**63), -1, 0, 2**63 - 1, None]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokenfile.round_trip(docs, BYTE_BPE).collect()}
    assert got == {i: len(whole(f"text {i}")) + 1 for i in ids}


def test_only_the_batches_asked_for_are_read(spark, docs, tmp_path):
    manifest = tokenfile.write(docs, str(tmp_path), BYTE_BPE, length=64, rows_per_batch=4).orderBy("n_ids").collect()

    class Handle:
        def __init__(self, path):
            self.file, self.bytes, self.closed = open(path, "rb"), 0, False

        def read(self, n=-1):
            out = self.file.read(n)
            self.bytes += len(out)
            return out

        def seek(self, *at):
            return self.file.seek(*at)

        def tell(self):
            return self.file.tell()

        def flush(self):
            pass

        def close(self):
            self.file.close()

    path = tmp_path / manifest[-1]["file"]
    handle = Handle(path)
    file = tokenfile.Sequences(pa.PythonFile(handle, mode="r"))
    before = handle.bytes
    file.ids(manifest[-1]["n_ids"] // 64 - 1)
    assert handle.bytes - before < 20_000 < path.stat().st_size


def test_texts_come_together_up_to_a_size():
    texts = ["a" * n for n in (3, 4, 50, 1, 1, 1)] + [None, "", "b" * 9]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    parts = [b.column("text").to_pylist() for b in tokens.texts_together([batch], 8)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [2, 1, 5, 1]
    odd = ["a  b", "", "x y", " ", "a \n b c", "tail ", None, "z\x85 w", "plain words here", " lead"]
    assert ENCODER.encode(pa.array(odd)) == [ENCODER.encode([t or ""])[0] for t in odd]
