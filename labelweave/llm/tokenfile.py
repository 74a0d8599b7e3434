"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file with the columns ``ids``, a fixed-size list of
unsigned integers in the narrowest width that the vocabulary needs, and
``mask``, a fixed-size list of bits that are false where the last sequence is
padded. Both are uncompressed, so a reader that maps the file gets at any
sequence without copying, and one that doesn't reads no more than the batches
it asks for. The schema's metadata holds the doc_ids of the file and their
numbers of ids, as little-endian 64-bit integers, and a bit for each that
tells whether it has a doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm.files import committed
from labelweave.llm.tokens import encoder, texts_together
from labelweave.plans.durable import run_dir, stored

MANIFEST = "file string, n_docs bigint, n_ids bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _batches(ids: np.ndarray, length: int, rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(ids), length * rows):
        part = ids[start : start + length * rows]
        pad = -len(part) % length
        mask = np.ones(len(part) + pad, dtype=bool)
        mask[len(part) :] = False
        values = pa.array(np.concatenate([part, np.zeros(pad, dtype=part.dtype)]))
        columns = [pa.FixedSizeListArray.from_arrays(x, length) for x in (values, pa.array(mask))]
        yield pa.record_batch(columns, schema=schema)


def write(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2,
    length: int = 2048, ids_per_file: int = 8_000_000, rows_per_batch: int = 256,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    Returns the manifest, one row per file: file names sort as the doc_ids
    they hold. A task starts the next file after ``ids_per_file`` ids, which
    bounds its memory; a document is never split over files. Rows with equal
    doc_id follow each other by text; null doc_ids come first and a null text
    is the end id alone. An empty table gives no file. Other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        width = np.uint16 if max(len(encode.width) - 1, end_id) < 1 << 16 else np.uint32
        end = end_id.to_bytes(4, "little")
        held: list[tuple[int, np.ndarray]] = []
        size = nth = 0

        def close() -> pa.RecordBatch:
            nonlocal size, nth
            name = f"part-{TaskContext.get().partitionId():06d}-{nth:06d}.arrow"
            meta = {
                "doc_ids": np.array([i or 0 for i, _ in held], dtype="<i8").tobytes(),
                "named": np.packbits([i is not None for i, _ in held], bitorder="little").tobytes(),
                "n_tokens": np.array([len(x) for _, x in held], dtype="<i8").tobytes(),
            }
            kinds = (pa.from_numpy_dtype(width), pa.bool_())
            fields = [pa.field(n, pa.list_(k, length)) for n, k in zip(("ids", "mask"), kinds)]
            schema = pa.schema(fields, metadata=meta)
            with committed(folder, name) as sink, pa.ipc.new_file(sink, schema) as out:
                for batch in _batches(np.concatenate([x for _, x in held]), length, rows_per_batch, schema):
                    out.write_batch(batch)
            row = pa.record_batch([[name], [len(held)], [size]], names=["file", "n_docs", "n_ids"])
            held.clear()
            size, nth = 0, nth + 1
            return row

        for batch in texts_together(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text"))):
                held.append((doc_id, np.frombuffer(raw + end, dtype="<u4").astype(width)))
                size += len(held[-1][1])
                if size >= ids_per_file:
                    yield close()
        if held:
            yield close()

    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


class Sequences:
    """Random access to one file; only the batches asked for are read.

    From a mapped file or a buffer the sequences and masks are views on its bytes.
    """

    def __init__(self, source: pa.NativeFile | pa.Buffer):
        self.reader = pa.ipc.open_file(source)
        meta = self.reader.schema.metadata
        self.n_tokens = np.frombuffer(meta[b"n_tokens"], dtype="<i8")
        named = np.unpackbits(np.frombuffer(meta[b"named"], dtype=np.uint8), count=len(self.n_tokens), bitorder="little")
        self.doc_ids = pa.array(np.frombuffer(meta[b"doc_ids"], dtype="<i8"), mask=named == 0)
        self.length = self.reader.schema.field("ids").type.list_size
        self.last = (-1, None)
        self.rows = self._batch(0).num_rows if self.reader.num_record_batches else 0

    def _batch(self, n: int) -> pa.RecordBatch:
        if self.last[0] != n:
            self.last = (n, self.reader.get_batch(n))
        return self.last[1]

    def _values(self, n: int) -> np.ndarray:
        return self._batch(n).column("ids").values.to_numpy(zero_copy_only=True)

    def ids(self, i: int) -> np.ndarray:
        """Sequence ``i``, with its padding."""
        return self._values(i // self.rows).reshape(-1, self.length)[i % self.rows]

    def mask(self, i: int) -> pa.BooleanArray:
        """Which ids of sequence ``i`` are not padding, as a view on the file's bits."""
        return self._batch(i // self.rows).column("mask")[i % self.rows].values

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``, counted over all sequences of the file."""
        size = self.rows * self.length
        parts = [self._values(n)[max(0, start - n * size) : stop - n * size] for n in range(start // size, -(-stop // size))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document in the files of ``folder`` that ``manifest`` (file, n_ids) names, with a checksum over its ids.

    ``start`` is the number of ids in all documents before it. Its running sum
    is over the manifest, one row per file of millions of ids, and travels
    with the file names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        if isinstance(store, fs.LocalFileSystem):
            store = fs.LocalFileSystem(use_mmap=True)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    file = Sequences(source)
                    ends = np.cumsum(file.n_tokens)
                    before = ends - file.n_tokens
                    sums = [zlib.crc32(file.span(a, b).astype("<u4").tobytes()) for a, b in zip(before.tolist(), ends.tolist())]
                    columns = [file.doc_ids, pa.array(base + before), pa.array(file.n_tokens), pa.array(sums, pa.int64())]
                    yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    return files.repartition(max(1, manifest.count())).mapInArrow(run, DOCUMENTS)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, **layout: int) -> DataFrame:
    """Write ``docs`` to a fresh folder and read every document back from the files."""
    spark = docs.sparkSession
    folder = run_dir(spark, "token-files")
    manifest = write(docs, folder, vocabulary, end_id, **layout)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read(manifest, folder)
