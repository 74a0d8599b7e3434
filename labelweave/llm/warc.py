"""WARC archives: writing whole-file gzip streams, normalising them, reading by offset.

A crawler may leave an archive as one gzip stream over all its records, which
can only be read from its start. ``normalise`` inflates such a stream once,
rewrites every record as a gzip member of its own and writes a sidecar index
with the place of each, so that any record can be fetched alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.files import committed
from labelweave.llm.worker import slices
from labelweave.plans.durable import run_dir, stored

# Fixed values of the WARC format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"

PAGE_URN = "urn:labelweave:page:"
GZIP = 16 + zlib.MAX_WBITS
CHUNK = 1 << 20
BROADCAST_ROWS = 100_000
RECORDS = "file string, offset bigint, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def payload_of(html: str = "html") -> Column:
    return F.coalesce(F.col(html), F.lit(""))


def with_first_copy(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``first``, the smallest page_id of an earlier copy, or null.

    Payloads are equal when their SHA-256 is. Only digests that occur more
    than once are joined back: by broadcast when their counted number is
    small, else on the digest, where a hot one is split by the skew join.
    Rows that tie on the smallest page_id all stay first.
    """
    digest = F.sha2(payload_of(), 256)
    long_enough = F.octet_length(payload_of()) >= least
    copies = (
        pages.where(long_enough).groupBy(F.unhex(digest).alias("digest"))
        .agg(F.min("page_id").alias("smallest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "smallest")
    )
    copies = stored(copies, "payload-copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    keyed = pages.withColumn("digest", F.when(long_enough, F.unhex(digest)))
    joined = keyed.join(copies, "digest", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("smallest"))
    return joined.select("page_id", "url", "html", F.when(~is_first, F.col("smallest")).alias("first"))


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """A response record, or a revisit of page ``first`` that leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"{PAGE_URN}{page_id}"
    fields = [
        ("WARC-Type", "revisit" if first is not None else "response"),
        ("WARC-Record-ID", f"<{PAGE_URN}{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if first is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{first}>")]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + BREAK


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_monolithic(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", bytes_per_file: int = 32 << 20, level: int = 1
) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html, first), each file one gzip stream.

    Returns the manifest (file, n_records). A null html is an empty payload;
    a null url is named after the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in slices(batches, 256):
                columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))
                for page_id, url, html, first in zip(*columns):
                    yield record(page_id, url, (html or "").encode(), first, date)

        rest, nth = records(), 0
        upcoming = next(rest, None)
        while upcoming is not None:
            name = f"part-{TaskContext.get().partitionId():06d}-{nth:06d}.warc.gz"
            size = n = 0
            with committed(folder, name) as sink:
                stream = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                while upcoming is not None and size < bytes_per_file:
                    sink.write(stream.compress(upcoming))
                    size, n = size + len(upcoming), n + 1
                    upcoming = next(rest, None)
                sink.write(stream.flush())
            nth += 1
            yield pa.record_batch([[name], [n]], names=["file", "n_records"])

    return stored(pages.mapInArrow(run, "file string, n_records bigint"), "warc-manifest")


def inflated(source: pa.NativeFile) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in bounded pieces."""
    stream = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            if stream.eof:
                stream = zlib.decompressobj(GZIP)
            yield stream.decompress(data, 4 * CHUNK)
            data = stream.unused_data if stream.eof else stream.unconsumed_tail
    while not stream.eof:
        piece = stream.decompress(b"", 4 * CHUNK)
        if not piece:
            raise ValueError("the gzip stream ends early")
        yield piece


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of bytes; memory holds one record and one piece."""
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if not need:
                end = held.find(BREAK, at)
                if end < 0:
                    break
                length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", held[at:end])
                if not held.startswith(b"WARC/", at) or not length:
                    raise ValueError("not a WARC record")
                need = end - at + len(BREAK) + int(length[1]) + len(BREAK)
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held.strip(b"\r\n"):
        raise ValueError("the last WARC record ends early")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the archives in ``folder``; their content is not read here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"))


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the archives of ``source`` with one gzip member per record.

    Beside each archive stands ``<name>.idx``, a line "offset length" per
    record. Files are streamed, so their size doesn't matter. Returns the
    manifest (file, n_records).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(source)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                offset, lines = 0, []
                with committed(target, name) as sink, store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for whole in split_records(inflated(raw)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = packer.compress(whole) + packer.flush()
                        sink.write(member)
                        lines.append(b"%d %d\n" % (offset, len(member)))
                        offset += len(member)
                with committed(target, f"{name}.idx") as sink:
                    sink.write(b"".join(lines))
                yield pa.record_batch([[name], [len(lines)]], names=["file", "n_records"])

    return stored(_files(spark, source).mapInArrow(run, "file string, n_records bigint"), "warc-normalised")


def parse(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the block."""
    head, _, rest = whole.partition(BREAK)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def _page(reference: str | None) -> int | None:
    number = (reference or "").strip("<>").removeprefix(PAGE_URN)
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def described(whole: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    fields, block = parse(whole)
    http, _, payload = block.partition(BREAK)
    length = int(re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)[1])
    kept = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != length or digest_of(payload) != kept):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    return (
        _page(fields["warc-record-id"]), fields["warc-target-uri"], length, kept,
        fields["warc-type"], _page(fields.get("warc-refers-to")),
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the normalised archives, fetched by its place in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        fields = RECORDS.replace(" string", "").replace(" bigint", "").split(", ")
        kinds = [pa.int64() if k.endswith("bigint") else pa.string() for k in RECORDS.split(", ")]
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}.idx") as raw:
                    places = [tuple(map(int, line.split())) for line in raw.read().splitlines()]
                with store.open_input_file(f"{root}/{name}") as archive:
                    for start in range(0, len(places), 1024):
                        rows = [
                            (name, offset, *described(zlib.decompress(archive.read_at(length, offset), GZIP)))
                            for offset, length in places[start : start + 1024]
                        ]
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    return _files(spark, folder).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them and read all records back.

    Rows with nulls, empty payloads and repeated rows each give a record;
    columns other than page_id, url and html are not read; an empty table
    gives no rows.
    """
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    pages = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    if write_monolithic(with_first_copy(pages, least), f"{folder}/monolithic").isEmpty():
        return spark.createDataFrame([], RECORDS)
    normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    return read(spark, f"{folder}/members")
