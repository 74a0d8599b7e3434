"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The groups are those of all such pairs; no candidate is left to chance. With
J >= 0.8, sets of n and m shingles share 0.8 max(n, m) of them, so in any
order of shingles that all texts use alike, two near copies share one of the
first n - ceil(0.8 n) + 1 of each, and l of the first n - ceil(0.8 n) + l.

1. In the order of their hashes: a set of whose first shingles too few occur
   in any other set can't have a near copy. Nearly all texts end here.
2. In the order of rising frequency among the sets that are left: sets that
   share one of their rarest shingles are candidates. Of all sets with a
   shingle, first only one meets the others; its near copies are one group
   from then on, and only pairs of different groups are compared after that.
   Sets whose SimHashes differ in two bits are met in the first round too.
3. A candidate is dropped when the parities of its shingles' counts in slots
   differ more often than the sets may; what is left is compared exactly.
4. Pairs of different groups are met block by block inside the tasks, where
   sketches drop them before they are rows. Of those left a block first names
   a forest, and the sets of the others; these meet once more when the forest
   has been compared, and all their pairs of groups still different are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.llm import simhash
from labelweave.llm.graph import connected_components
from labelweave.llm.worker import begin, slices, tidy
from labelweave.plans.durable import discard, stored

WORDS = 5
TOKENS_TOGETHER = 400_000
TOKENS_PER_PART = 500_000
LEAST_PARTS = 16
SALTS = 16
BLOCK = 512
PAIRS_TOGETHER = 1 << 13
TRAVELS = 512  # bytes of a sketch that go with a set's shingles
MOST_SLOTS = 1 << 21  # rows of a broadcast
SLOT = "_labelweave_slot"
KEY = 16
KEYS = f"V{KEY}"
DOCUMENT, COUNTED, SEEN_HERE = 0, 1, 2  # kinds of rows
ROWS = "kind int, part int, doc_id bigint, text_key string, set_key binary, n bigint, credit bigint, tokens binary, owners binary, keys binary"
SETS = "set_key binary, n bigint, fp bigint, tokens array<bigint>, sketch binary, short binary"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words of the whole text; words are those of ``simhash.fingerprint``.

    Fewer words make one shingle; a text without words has none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - WORDS + 1) if words else 0
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + WORDS]), simhash.SEED) for i in range(n)], dtype="<u8"))


def set_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=KEY).digest()


def shared_least(n: int) -> int:
    """How many of ``n`` shingles every near copy has."""
    return -(-4 * n // 5)


def _extra(n: int) -> int:
    """How many of its first shingles a set of ``n`` shares with near copies no smaller than itself."""
    return (n - shared_least(n) + 2) // 2


def first_shingles(n: int) -> tuple[int, int]:
    """(how many first shingles of a set of ``n`` are looked at, how many of them any near copy shares)."""
    return min(n, n - shared_least(n) + _extra(n)), _extra(shared_least(n))


def sketch(found: np.ndarray) -> bytes:
    """Parities of the counts of shingles in at least twice as many slots, a power of two; halves fold by exclusive or."""
    slots = 2 << max(6, int(len(found) - 1).bit_length())
    counts = np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def _parities(column: list[bytes], size: int, to: int) -> np.ndarray:
    out = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), size)
    while size > to:
        size //= 2
        out = out[:, :size] ^ out[:, size:]
    return out


def possible(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of sketches, of sets of sizes ``n`` and ``m``, can be near copies.

    Every shingle that only one set has turns one parity, and near copies have
    (n + m) / 9 of those at most.
    """
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)], dtype=np.int64).reshape(-1, 2)
    out = np.zeros(len(a), dtype=bool)
    for la, lb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (la, lb)).all(axis=1))
        low = min(la, lb)
        left, right = _parities([a[i] for i in at], la, low), _parities([b[i] for i in at], lb, low)
        out[at] = 9 * np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= n[at] + m[at]
    return out


def _short(whole: bytes) -> bytes:
    return _parities([whole], len(whole), min(len(whole), TRAVELS)).tobytes()


def _rows(count: int, **columns) -> pa.RecordBatch:
    """A record batch of ``ROWS`` with nulls where nothing is given."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in ROWS.split(", ")]
    arrays = [pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(count, kinds[k]) for n, k in fields]
    return pa.record_batch(arrays, names=[n for n, _ in fields])


def _dealt(docs: DataFrame, bits: int) -> DataFrame:
    """Documents with the key and size of their set, and the sets' first shingles by parts of the hash range.

    Equal sets of a batch are one. A shingle that several sets of a batch have
    counts for them at once and travels once, so a frequent one is a row per
    batch.
    """
    parts = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("nearcopies")
        keys: dict[bytes, int] = {}
        firsts: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            named = np.frombuffer(b"".join(keys), dtype=KEYS)
            tokens = np.concatenate([*firsts, np.empty(0, "<u8")])
            owner = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order].astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(tokens)))
            credit = np.bincount(owner[np.repeat(sizes > 1, sizes)], minlength=len(firsts))
            tokens, owner = tokens[starts], np.where(sizes > 1, -1, owner[starts])
            cuts = np.searchsorted(tokens, np.arange(1, parts, dtype="<u8") << np.uint64(64 - bits)) if bits else []
            out = []
            for part, (own, who) in enumerate(zip(np.split(tokens, cuts), np.split(owner, cuts))):
                if len(own):
                    held = np.unique(who[who >= 0])
                    place = np.where(who >= 0, np.searchsorted(held, who), -1).astype("<i4")
                    out.append((part, own.astype("<u8").tobytes(), place.tobytes(), named[held].tobytes()))
            if out:
                part, own, place, held = zip(*out)
                yield _rows(len(out), kind=[COUNTED] * len(out), part=part, tokens=own, owners=place, keys=held)
            here = np.flatnonzero(credit)
            if len(here):
                chosen = [k.tobytes() for k in named[here]]
                yield _rows(len(here), kind=[SEEN_HERE] * len(here), part=here % parts, set_key=chosen, credit=credit[here])
            keys.clear()
            firsts.clear()

        size = 0
        for batch in slices(batches, 256):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            own = [set_key(s) for s in sets]
            for key, s in zip(own, sets):
                if key not in keys:
                    keys[key] = len(keys)
                    firsts.append(s[: first_shingles(len(s))[0]].copy())
                    size += len(firsts[-1])
            yield _rows(
                len(sets), kind=[DOCUMENT] * len(sets), part=np.arange(len(sets)) % parts, doc_id=batch.column("doc_id").to_pylist(),
                text_key=batch.column("text_key").to_pylist(), set_key=own, n=[len(s) for s in sets],
            )
            if size >= TOKENS_TOGETHER:
                yield from close()
                size = 0
        yield from close()

    return _keyed(docs).mapInArrow(tidy(run), ROWS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key) of every row; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.md5(text).alias("text_key"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes rows on; the shingles of one part become the number that each set shares with others there."""
    tokens: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    numbers: dict[bytes, int] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        yield batch.filter(pa.array(kinds != COUNTED))
        for i in np.flatnonzero(kinds == COUNTED).tolist():
            own, place, held = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t) for c, t in (("tokens", "<u8"), ("owners", "<i4"), ("keys", KEYS)))
            numbered = np.array([numbers.setdefault(k.tobytes(), len(numbers)) for k in held] + [-1], dtype=np.int32)
            tokens.append(own.copy())
            owners.append(numbered[place])
    if not tokens:
        return
    own, who = np.concatenate(tokens), np.concatenate(owners)
    order = np.lexsort((who, own))
    own, who = own[order], who[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (who[1:] != who[:-1])])
    own, who = own[new], who[new]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    sizes = np.diff(np.append(starts, len(own)))
    # The mark of several sets of a batch sorts first in its group.
    shared = np.repeat((sizes > 1) | (who[starts] < 0), sizes) & (who >= 0)
    credit = np.bincount(who[shared], minlength=len(numbers))
    here = np.flatnonzero(credit)
    if len(here):
        chosen = [k.tobytes() for k in np.frombuffer(b"".join(numbers), dtype=KEYS)[here]]
        yield _rows(len(here), kind=[COUNTED] * len(here), part=[0] * len(here), set_key=chosen, credit=credit[here])


def _marked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, set_key) of every row, and the keys of sets that may have near copies."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # About three in ten words are looked at; a word is six characters or so.
    bits = max(LEAST_PARTS, chars // 20 // TOKENS_PER_PART).bit_length()
    placed = _dealt(docs, bits).repartitionById(1 << bits, F.col("part"))
    rows = stored(placed.mapInArrow(tidy(_counted), ROWS).select("kind", "doc_id", "text_key", "set_key", "n", "credit"), "near-marks")
    # A set with copies may be counted here and there too; that keeps it, and never drops one.
    there = F.coalesce(F.sum(F.when(F.col("kind") == COUNTED, F.col("credit"))), F.lit(0))
    here = F.coalesce(F.max(F.when(F.col("kind") == SEEN_HERE, F.col("credit"))), F.lit(0))
    credits = rows.groupBy("set_key").agg((there + here).alias("credit"), F.max("n").alias("n"))
    smaller = credits.withColumn("least", _least("n"))
    need = F.expr("(least - ((4 * least + 4) div 5) + 2) div 2")
    return rows.where(F.col("kind") == DOCUMENT).select("doc_id", "text_key", "set_key"), smaller.where((F.col("credit") > 0) & (F.col("credit") >= need)).select("set_key")


def _text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _slots(keys: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """(slots that the text keys in ``column`` hash to, condition that a text does too), to join before texts are shuffled.

    Other texts pass by chance, one in sixteen or fewer up to a sixteenth of
    ``MOST_SLOTS`` keys, more beyond; so a join on the whole key must follow.
    """
    slots = min(MOST_SLOTS, 16 << keys.count().bit_length())
    held = keys.select(F.pmod(F.xxhash64(column), F.lit(slots)).alias(SLOT)).distinct()
    return F.broadcast(held), F.pmod(F.xxhash64(_text_key()), F.lit(slots)) == F.col(SLOT)


def _sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets that ``wanted`` names, with an id, their SimHash and sketch; one row a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = batch.column("text").to_pylist()
            sets = [shingles(t) for t in texts]
            sketches = [sketch(s) for s in sets]
            yield pa.record_batch(
                [
                    pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([simhash.fingerprint(t) for t in texts], pa.int64()),
                    pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                    pa.array([_short(s) for s in sketches], pa.binary()),
                ],
                names=[f.split()[0] for f in SETS.split(", ")],
            )

    texts = stored(marked.join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.min("text_key").alias("text_key")), "near-wanted")
    held, likely = _slots(texts, "text_key")
    found = _keyed(docs.join(held, likely, "left_semi")).join(texts.select("text_key"), "text_key", "left_semi").select("text").mapInArrow(tidy(run), SETS)
    return stored(found.dropDuplicates(["set_key"]).withColumn("id", F.monotonically_increasing_id()), "near-sets")


def _least(n: str) -> Column:
    return F.expr(f"(4 * {n} + 4) div 5")


def _index(sets: DataFrame) -> DataFrame:
    """(token, id, n): for each set its rarest shingles, of which near copies share one; those of no other set are left out."""
    rows = sets.select("id", "n", F.explode("tokens").alias("token"))
    counts = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "near-counts")
    own = Window.partitionBy("id")
    placed = rows.join(counts, "token").select(
        "token", "id", "n", F.row_number().over(own.orderBy("sets", "token")).alias("nth"), F.count(F.lit(1)).over(own).alias("known")
    )
    # Shingles of one set come before all these.
    return stored(placed.where(F.col("nth") <= F.col("known") - _least("n") + 1).select("token", "id", "n"), "near-index")


def _fits(n: Column, m: Column) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) with a similarity of 0.8 or more, as a table.

    Sketches are compared first. Then the shingles of each ``b`` travel once
    per pair, and those of ``a`` once for each of its blocks of pairs.
    """

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            kept = possible(left, right, batch.column("n").to_numpy(), batch.column("m").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in slices(batches, 256):
            kept = []
            tokens = batch.column("tokens")
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                other = tokens[i].values.to_numpy().view("<u8")
                if b is None:
                    mine = other
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 5 * both >= 4 * (len(mine) + len(other) - both):
                    kept.append((a, b))
            a, b = zip(*kept) if kept else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), "n", F.col("sketch").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("right"))
    close = stored(pairs.distinct().join(left, "a").join(right, "b").mapInArrow(tidy(able), "a bigint, b bigint"), "near-pairs")
    salted = close.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    others = salted.join(sets.select(F.col("id").alias("b"), "tokens"), "b").select("a", "salt", "b", "tokens")
    own = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), "tokens"), "a")
    both = own.select("a", "salt", F.lit(None).cast("bigint").alias("b"), "tokens").unionByName(others)
    ordered = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    found = stored(ordered.mapInArrow(tidy(compare), "a bigint, b bigint"), "near-links")
    discard(close)
    return found


def _first_round(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets: the first one of each shingle with the others, and those with close SimHashes."""
    heads = index.groupBy("token").agg(F.min(F.struct("id", "n")).alias("head")).select("token", F.col("head.id").alias("a"), F.col("head.n").alias("m"))
    met = index.join(heads, "token").where((F.col("id") != F.col("a")) & _fits(F.col("n"), F.col("m"))).select("a", F.col("id").alias("b"))
    fps = sets.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("first"))
    fps = stored(fps.select("fp", F.col("first.id").alias("id"), F.col("first.n").alias("n")), "near-simhashes")
    own = sets.select("fp", F.col("id").alias("b"), F.col("n").alias("m")).join(fps, "fp").where("id <> b")
    left, right = (fps.select(F.col("fp").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    across = simhash.links(sets).join(left, "a").join(right, "b").where(_fits(F.col("n_a"), F.col("n_b")))
    near = own.where(_fits(F.col("n"), F.col("m"))).select(F.col("id").alias("a"), "b").unionByName(
        across.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    )
    return met.unionByName(near.where("a < b"))


def _blocks(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of each shingle that several groups have, dealt into pairs of blocks (token, f, x).

    Those of a shingle's largest group, the blocks from ``few`` on, meet only
    sets of other groups, the blocks before; where there is one group there is
    nothing to compare. Block f is the left one; its sets meet one another
    where x is ``few``, which every f has.
    """
    grouped = stored(
        index.join(nodes, F.col("id") == F.col("node"), "left").select("token", "id", "n", F.coalesce("component", "id").alias("own")), "near-grouped"
    )
    sizes = grouped.groupBy("token", "own").agg(F.count(F.lit(1)).alias("members"))
    mixed = sizes.groupBy("token").agg(
        F.max(F.struct("members", "own")).alias("top"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("groups")
    ).where("groups > 1")
    blocks = [F.ceil(n / BLOCK).alias(x) for n, x in ((F.col("members") - F.col("top.members"), "few"), (F.col("top.members"), "most"))]
    place = F.expr("if(own <> top, pmod(xxhash64(id), few), few + pmod(xxhash64(id), most))")
    rows = grouped.join(mixed.select("token", F.col("top.own").alias("top"), *blocks), "token").withColumn("block", place)
    # A block of few meets every other one, and itself beside the first of most.
    others = F.expr("filter(sequence(0L, if(block < few, few + most, few) - 1), y -> y <> block)")
    dealt = rows.select("token", "id", "n", "own", "few", "block", F.explode(others).alias("other"))
    return dealt.select(
        "token", F.least("block", "other").alias("f"), F.greatest("block", "other").alias("x"),
        (F.col("block") < F.col("other")).alias("is_left"), "few", "id", "n", "own",
    )


def _close(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of different groups, in whole blocks, that sketches allow, and the share of slots that differ."""
    token, f, x, left, few, n, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "f", "x", "is_left", "few", "n", "own"))
    sketches = batch.column("short").to_pylist()
    sizes = np.array([len(s) for s in sketches], dtype=np.int64)
    held = {size: np.flatnonzero(sizes == size) for size in np.unique(sizes).tolist()}
    place = np.empty(len(sizes), dtype=np.int64)
    tables = {}
    for size, at in held.items():
        place[at] = np.arange(len(at))
        tables[size] = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), dtype="<u8").reshape(len(at), size // 8)
    starts = _starts(token, f, x)
    ends = np.repeat(np.append(starts[1:], len(token)), np.diff(np.append(starts, len(token))))
    # Left rows stand first; each meets what follows them, or it, up to the end.
    rights = np.repeat(starts + np.add.reduceat(left.astype(np.int64), starts), np.diff(np.append(starts, len(token))))
    mine = np.flatnonzero(left)
    since = np.where(x == few, np.arange(len(token)) + 1, rights)[mine]
    counts = ends[mine] - since
    parts = np.searchsorted(np.cumsum(counts), np.arange(PAIRS_TOGETHER, counts.sum(), PAIRS_TOGETHER))
    found = []
    for rows, lows, many in zip(np.split(mine, parts), np.split(since, parts), np.split(counts, parts)):
        a = np.repeat(rows, many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lows, many)
        kept = (own[a] != own[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
        a, b = a[kept], b[kept]
        differ = np.zeros(len(a), dtype=np.int64)
        for la, lb in set(zip(sizes[a].tolist(), sizes[b].tolist())):
            at = np.flatnonzero((sizes[a] == la) & (sizes[b] == lb))
            differ[at] = np.bitwise_count(_folded(tables[la][place[a[at]]], lb) ^ _folded(tables[lb][place[b[at]]], la)).sum(axis=1, dtype=np.int64)
        kept = 9 * differ <= n[a] + n[b]
        found.append((a[kept], b[kept], differ[kept] / np.maximum(1, n[a[kept]] + n[b[kept]])))
    a, b, differ = (np.concatenate(c) for c in zip(*found))
    return a, b, differ


def _folded(table: np.ndarray, to: int) -> np.ndarray:
    """Sketches, eight bytes a column, folded to ``to`` bytes if they are longer."""
    while table.shape[1] > max(1, to // 8):
        half = table.shape[1] // 2
        table = table[:, :half] ^ table[:, half:]
    return table


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows have another key than the one before."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def _forest(a: np.ndarray, b: np.ndarray, differ: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which pairs join groups that those likelier than they don't join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    joins = np.zeros(len(a), dtype=bool)
    for i in np.argsort(differ, kind="stable").tolist():
        x, y = find(int(own[a[i]])), find(int(own[b[i]]))
        if x != y:
            root[y] = x
            joins[i] = True
    return joins


def _across(index: DataFrame, nodes: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of sets of different groups so far that share a shingle and that sketches allow.

    With ``forest`` only some that would join all these groups; the sets of
    the others are then rows too, with no ``b``. Tasks hold two blocks and
    what they read at once; pairs that sketches drop are never rows.
    """

    def meet(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, differ = _close(batch)
        ids = batch.column("id").to_numpy()
        joins = _forest(a, b, differ, batch.column("own").to_numpy()) if forest else np.ones(len(a), dtype=bool)
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        pairs = np.unique(np.stack([low[joins], high[joins]], axis=1), axis=0)
        more = np.unique(np.concatenate([low[~joins], high[~joins]]))
        return pa.record_batch(
            [pa.array(np.concatenate([pairs[:, 0], more])), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(more), pa.int64())])], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in slices(batches, 8 * BLOCK):
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            whole = int(_starts(*(rest.column(c).to_numpy() for c in ("token", "f", "x")))[-1]) if rest.num_rows else 0
            if whole:
                yield meet(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield meet(rest)

    place = ["token", "f", "x"]
    rows = _blocks(index, nodes).join(sets.select("id", "short"), "id")
    ordered = rows.repartition(*place).sortWithinPartitions(*place, F.desc("is_left"))
    return stored(ordered.mapInArrow(tidy(run), "a bigint, b bigint"), "near-across")


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Components of those that ``nodes`` has and of the ``links`` between them."""
    return connected_components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, group_key, component_id) of every row of ``docs`` (doc_id, text).

    Rows of one group have one group_key, and component_id is its smallest
    doc_id. text_key is the MD5 of the text. The number of jobs doesn't depend
    on how many sets share a shingle. Rows with one set of shingles are one
    node; texts without words are alike. A null doc_id takes its group's
    component_id but never names it; an empty table gives no rows; other
    columns are not read.
    """
    marked, wanted = _marked(docs)
    sets = _sets(docs, marked, wanted)
    index = _index(sets)
    nodes = connected_components(_alike(_first_round(sets, index), sets))
    some = _across(index, nodes, sets, forest=True)
    nodes = _joined(nodes, _alike(some.where("b is not null"), sets))
    left = stored(index.join(some.where("b is null").select(F.col("a").alias("id")).distinct(), "id", "left_semi"), "near-left")
    nodes = _joined(nodes, _alike(_across(left, nodes, sets, forest=False), sets))
    roots = sets.select("id", "set_key").join(nodes, F.col("id") == F.col("node")).select("set_key", "component")
    grouped = marked.join(roots, "set_key", "left").withColumn(
        "group_key", F.when(F.col("component").isNull(), F.hex("set_key")).otherwise(F.col("component").cast("string"))
    )
    grouped = stored(grouped.select("doc_id", "text_key", "group_key"), "near-groups")
    smallest = grouped.groupBy("group_key").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(smallest, "group_key").select("doc_id", "text_key", "group_key", "component_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns.

    It is the row with the smallest doc_id, null being the largest; of rows
    that share it, that with the smallest MD5 of its text; of rows equal in
    both, any one. Texts meet the keys of rows that go, which are looked up by
    doc_id and MD5, so that rows of one doc_id are told apart.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    found = stored(groups(docs), "near-rows")
    kept = found.groupBy("group_key").agg(F.min(rank).alias("first"), F.min_by(F.col("text_key"), rank).alias("kept_key"))
    judged = found.join(kept, "group_key").withColumn("is_first", rank == F.col("first"))
    gone = stored(judged.where("not is_first").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "near-gone")
    repeated = stored(
        judged.where("is_first").groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).count().where("count > 1").drop("count"),
        "near-repeated",
    )
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("gone_id")) & (_text_key() == F.col("gone_key"))
    held, likely = _slots(gone, "gone_key")
    left = docs.join(held, likely, "left_anti").unionByName(docs.join(held, likely, "left_semi").join(gone, same, "left_anti"))
    once = left.join(repeated, same, "left_anti")
    several = left.join(repeated, same, "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", F.md5(F.coalesce("text", F.lit("")))).orderBy(F.lit(1)))
    position = "_labelweave_nth"
    return once.unionByName(several.withColumn(position, nth).where(F.col(position) == 1).drop(position))
