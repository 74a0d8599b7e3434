"""SimHash near-duplicates by multi-index hashing.

Two 64-bit fingerprints that differ in at most two bits differ in at most one
bit of some 32-bit segment. Each fingerprint stands in one table per segment;
a probe enumerates the Hamming ball of radius one around its own segment,
fetches the table's matches and verifies the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.graph import connected_components
from labelweave.llm.worker import slices
from labelweave.plans.durable import stored

SEED = 42
MAX_BITS = 2
HOT_BUCKET = 4096


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The SimHash of a whole text; zero when it has no word.

    A-Z are lower-cased; words are runs without blank, tab, line feed,
    vertical tab, form feed or carriage return; fewer words than a shingle
    make one shingle. A bit is set when it is set in over half the hashes.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    hashes = [xxh64_intdigest(b" ".join(words[i : i + words_per_shingle]), SEED) for i in range(n)]
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 65_536):
        part = np.array(hashes[start : start + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); fp is a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            fps = [fingerprint(t, words_per_shingle) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _segments() -> Column:
    """Both 32-bit segments as (segment number, value)."""
    low, high = F.expr("fp & 4294967295"), F.expr("shiftrightunsigned(fp, 32)")
    return F.explode(F.array(F.struct(F.lit(0).alias("segment"), low.alias("key")), F.struct(F.lit(1).alias("segment"), high.alias("key"))))


def _ball(column: str, bits: int) -> Column:
    """The value and every value with one more bit set.

    Of two values one bit apart, the one without the bit reaches the other.
    """
    free = f"filter(sequence(0, {bits - 1}), i -> (shiftright({column}, i) & 1) = 0)"
    return F.explode(F.expr(f"concat(array({column}), transform({free}, i -> {column} | shiftleft(1L, i)))"))


def _quarters(ball: bool) -> Column:
    """The 16-bit halves of the other segment, or the whole balls of radius one around them."""
    other = "(case when segment = 0 then shiftrightunsigned(fp, 32) else fp & 4294967295 end)"
    parts = []
    for q in (0, 1):
        value = f"(shiftright({other}, {16 * q}) & 65535)"
        around = f"concat(array({value}), transform(sequence(0, 15), i -> {value} ^ shiftleft(1L, i)))"
        parts.append(f"transform({around if ball else f'array({value})'}, v -> struct({q} as quarter, v as part))")
    return F.explode(F.expr(f"concat({', '.join(parts)})"))


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in ``fps`` (fp) at up to two bits; a pair may come twice.

    The distance is verified inside the join, so unlinked pairs are never
    rows. A bucket of more than ``hot_bucket`` fingerprints is looked up by
    the same rule once more, on the 16-bit halves of the other segment: two
    differing bits leave one of them with at most one.
    """
    rows = stored(fps.select("fp").distinct(), "fingerprints")
    # Spark judges a side before its balls are enumerated, so it is told not to broadcast it.
    table = rows.select("fp", _segments().alias("s")).select("fp", "s.segment", "s.key").hint("merge")
    probes = table.select(F.col("fp").alias("probe"), "segment", "key", _ball("key", 32).alias("near")).select(
        "probe", "segment", F.col("near").alias("key"), (F.col("near") == F.col("key")).alias("same")
    )
    hot = stored(table.groupBy("segment", "key").count().where(F.col("count") > hot_bucket).select("segment", "key"), "hot-buckets")
    close = F.expr(f"bit_count(probe ^ fp) <= {MAX_BITS} and (not same or probe < fp)")
    place = ["segment", "key"]
    if hot.isEmpty():
        found = probes.join(table, (probes.segment == table.segment) & (probes.key == table.key) & close)
        return found.select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    cool = table.join(hot, place, "left_anti").hint("merge")
    found = probes.join(cool, (probes.segment == cool.segment) & (probes.key == cool.key) & close)
    warm = table.join(hot, place, "left_semi").select("*", _quarters(ball=False).alias("q"))
    warm = warm.select("fp", *place, "q.quarter", "q.part").hint("merge")
    ask = (
        probes.join(hot, place, "left_semi").withColumnRenamed("probe", "fp")
        .select("*", _quarters(ball=True).alias("q"))
        .select(F.col("fp").alias("probe"), *place, "same", "q.quarter", "q.part")
    )
    keys = [ask[c] == warm[c] for c in (*place, "quarter", "part")]
    deeper = ask.join(warm, keys[0] & keys[1] & keys[2] & keys[3] & close)
    return found.select(F.col("probe").alias("a"), F.col("fp").alias("b")).unionByName(
        deeper.select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    )


def groups(docs: DataFrame, words_per_shingle: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links of at most two differing
    bits reach. Rows with one fingerprint are one node, so copies are never
    paired. A null, empty or blank text has fingerprint zero and is linked
    like any other. Repeated rows stay repeated; a null doc_id takes its
    group's component_id but never names it; an empty table gives no rows;
    other columns are not read.
    """
    marked = stored(fingerprints(docs, words_per_shingle), "simhash")
    nodes = connected_components(links(marked, hot_bucket))
    named = (
        marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
        .join(nodes, F.col("fp") == F.col("node"), "left")
        .select("fp", "smallest", F.coalesce("component", "fp").alias("component"))
    )
    roots = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    lookup = stored(named.join(roots, "component").select("fp", "component_id"), "simhash-groups")
    return marked.join(lookup, "fp").select("doc_id", "fp", "component_id")
