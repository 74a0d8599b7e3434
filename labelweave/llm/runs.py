"""Periodic runs of words, by difference-cover longest common extensions.

Positions of a sequence whose remainders lie in a difference cover are its
samples: for any two positions there is a small shift that makes both of them
samples. Only the suffixes at samples are sorted. The longest common
extension of two positions compares the few words up to that shift and then
takes the minimum of the sorted suffixes' common prefixes between the two, by
a sparse table.

A run of period p repeats p words, so it covers a multiple of p. Runs are
found by extending, for each period, pairs of neighbours on the grid of its
multiples to both sides; these grids are a harmonic sum of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm.worker import slices

# A perfect difference set. Every remainder of 31 is the difference of two of them.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)
LEAST_LENGTH = 12
CHARS_TOGETHER = 3_000_000
RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _shifts() -> np.ndarray:
    """The least shift that takes two remainders into the cover."""
    table = np.zeros((MODULUS, MODULUS), dtype=np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            table[a, b] = min(s for s in range(MODULUS) if (a + s) % MODULUS in COVER and (b + s) % MODULUS in COVER)
    return table


SHIFTS = _shifts()
PLACE = np.full(MODULUS, -1, dtype=np.int64)
PLACE[list(COVER)] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions in ``words``, non-negative integers.

    Extensions must end inside: of two different positions, one meets a value
    that occurs once. The sampled suffixes are sorted on first need.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(MODULUS, dtype=words.dtype)])
        self.rank: np.ndarray | None = None

    def _sort(self) -> None:
        blocks = -(-self.n // MODULUS)
        samples = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).reshape(-1)
        samples = samples[samples < self.n]
        windows = self.words[samples[:, None] + np.arange(MODULUS)]
        size, step = len(samples), len(COVER)
        as_bytes = windows.astype(">u4").view(f"S{4 * MODULUS}").reshape(-1)
        # Level k holds the ranks of stretches of MODULUS * 2**k words.
        levels = [np.unique(as_bytes, return_inverse=True)[1].reshape(-1).astype(np.int64)]
        while levels[-1].max(initial=0) + 1 < size:
            ahead = np.zeros(size, dtype=np.int64)
            ahead[: max(0, size - step)] = levels[-1][step:] + 1
            levels.append(np.unique(levels[-1] * (size + 1) + ahead, return_inverse=True)[1].reshape(-1))
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < size
            same = np.zeros(len(a), dtype=bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            skip = same * (len(COVER) << k)
            a, b, common = a + skip, b + skip, common + same * (MODULUS << k)
        inside = np.maximum(a, b) < size
        common[inside] += (windows[a[inside]] != windows[b[inside]]).argmax(axis=1)
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _deep(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Extensions of pairs of samples."""
        if self.rank is None:
            self._sort()
        a, b = (self.rank[x // MODULUS * len(COVER) + PLACE[x % MODULUS]] for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        width = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(width):
            at, table = width == k, self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out

    def longest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal words from each ``i`` and its ``j``; they differ."""
        shift = SHIFTS[i % MODULUS, j % MODULUS]
        out, open_ = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
        for k in range(MODULUS):
            synchronised = shift[open_] == k
            at = open_[synchronised]
            if len(at):
                out[at] = k + self._deep(i[at] + k, j[at] + k)
            open_ = open_[~synchronised]
            if not len(open_):
                break
            same = self.words[i[open_] + k] == self.words[j[open_] + k]
            out[open_[~same]] = k
            open_ = open_[same]
        return out


def _grid_pairs(words: np.ndarray, longest_period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of equal neighbours on the grids of all periods.

    A run of period p and of length ``max(least, 2 * p)`` or more has at least
    ``max(p, least - p)`` positions equal to that p later, one after the
    other, so a grid of that width meets one. Small periods are taken one by
    one; for larger ones, of which each has few multiples, the k-th multiples
    of all of them at once.
    """
    n = len(words)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = min(longest_period, max(least, isqrt(n)))
    for p in range(1, small + 1):
        step = max(p, least - p)
        hits = np.flatnonzero(words[: n - p : step] == words[p::step]) * step
        if len(hits):
            found.append((hits, np.full(len(hits), p)))
    for k in range(n // (small + 1)):
        first, last = small + 1, min(longest_period, (n - 1) // (k + 1))
        if first > last:
            break
        left = words[k * first : k * last + 1 : k] if k else words[0]
        periods = np.flatnonzero(left == words[(k + 1) * first : (k + 1) * last + 1 : k + 1]) + first
        if len(periods):
            found.append((periods * k, periods))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(texts: list[np.ndarray], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """For each text, a sequence of non-negative integers, its runs as rows (start, length, period) by start, then period.

    A run is a stretch of length ``max(least, 2 * period)`` or more, with its
    smallest period, that can't be extended to either side.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if sizes.max(initial=0) < least:
        return [np.empty((0, 3), dtype=np.int64) for _ in texts]
    # All texts in a row, between separators that occur once, so that no stretch leaves its text.
    base = 1 + max(int(t.max()) for t in texts if len(t))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
    words = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    words[0] = base
    for number, (start, text) in enumerate(zip(starts.tolist(), texts)):
        words[start : start + len(text)] = text
        words[start + len(text)] = base + 1 + number
    words = words.astype(np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), np.concatenate([[1], sizes + 1])) - 1
    i, p = _grid_pairs(words, int(sizes.max()) // 2, least)
    inside = owner[i] == owner[i + p]
    i, p = i[inside], p[inside]
    n = len(words)
    ahead = Extensions(words).longest(i, i + p)
    near = ahead > 0
    behind = Extensions(words[::-1]).longest(n - 1 - i[near], n - 1 - i[near] - p[near])
    i, p, ahead = i[near], p[near], ahead[near]
    start, length = i - behind + 1, ahead + behind - 1 + p
    whole = length >= np.maximum(least, 2 * p)
    # A multiple of a run's period gives the same stretch; the smallest comes first.
    rows = np.unique(np.stack([start[whole], length[whole], p[whole]], axis=1), axis=0)
    if len(rows):
        first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        rows = rows[first]
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = owner[rows[:, 0]] if len(rows) else np.empty(0, dtype=np.int64)
    rows[:, 0] -= starts[text]
    cuts = np.searchsorted(text, np.arange(1, len(texts)))
    return np.split(rows, cuts)


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words a run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH, chars_together: int = CHARS_TOGETHER) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text), over its whole text.

    Words are runs without blank, tab, line feed, vertical tab, form feed or
    carriage return. ``runs`` are ordered by start, then period; ``collapsed``
    holds the words that are left when every run keeps its first period only,
    joined by one blank. Texts of ``chars_together`` characters, or one longer
    text, are worked on at a time and nothing is shuffled.

    A null or empty text has no words, no runs and collapses to an empty
    text. Repeated rows and repeated or null doc_ids are worked on row by row;
    an empty table gives no rows; other columns are not read.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, size = [], [], 0
        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                if ids and size + len(text) > chars_together:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for ids, texts in together(batches):
            words = [t.encode().split() for t in texts]
            numbers: dict[bytes, int] = {}
            for row in words:
                for w in row:
                    if w not in numbers:
                        numbers[w] = len(numbers)
            found = find_runs([np.fromiter(map(numbers.__getitem__, row), np.int64, len(row)) for row in words], least)
            collapsed = []
            for row, runs in zip(words, found):
                if len(runs):
                    gone = dropped(runs, len(row)).tolist()
                    row = [w for w, out in zip(row, gone) if not out]
                collapsed.append(b" ".join(row).decode())
            every = np.concatenate(found)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], fields=list(span))
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), spans), pa.array(collapsed, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, RUNS)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` with a periodic end written into one text of ten, chosen by the CRC-32 h of the doc_id in decimals.

    With g = h div 10 and n words, word i from a = g mod n on becomes the word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8); the words of a
    changed text are joined by blanks. Texts without words and rows without a
    doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    listed = docs.select(F.col("doc_id").cast("bigint"), "text").withColumns(
        {"g": F.floor(h / 10), "w": F.when(h % 10 == 0, words)}
    )
    placed = listed.withColumn("a", F.expr("case when size(w) > 0 then g % size(w) end")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(w, (x, i) -> case when i < a then x else w[cast(a + (i - a) % p as int)] end), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def longest_run() -> Column:
    """The run with the greatest length in ``runs``; of several that with the smallest start, then period."""
    return F.expr(
        "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), "
        "(best, r) -> case when best is null or r.length > best.length then r else best end)"
    )
