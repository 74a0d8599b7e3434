"""Packing of token sequences into windows by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.tokens import encoder, texts_together
from labelweave.llm.worker import give_back, tidy

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
ID_BYTES = 4


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree over the capacities.

    A node tells whether any window with a capacity in its range is open, so
    the tightest fitting window is found in log2(window) steps.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window_id: int) -> None:
        self.windows[capacity].append(window_id)
        self._add(capacity, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """The open window with the smallest capacity of at least ``need``."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.count[node]:
                    node += 1
        capacity = node - self.leaves
        window_id = self.windows[capacity].pop()
        self._add(capacity, -1)
        return window_id, capacity

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each size; sizes are from 1 to ``window``."""
    open_windows, placed, opened = OpenWindows(window), [(0, 0)] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_windows.take_tightest(sizes[i])
        if found is None:
            found, opened = (opened, window), opened + 1
        number, capacity = found
        placed[i] = (number, window - capacity)
        if capacity > sizes[i]:
            open_windows.put(capacity - sizes[i], number)
    return placed


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = 1024, together: int = 4096, at_once: int = 1024) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and pack every id into windows.

    A document is its ids and ``end_id``. A document longer than ``window``
    is cut into full windows first; what is left of up to ``together``
    documents of a task is packed by best-fit decreasing, so memory is
    bounded by ``together * window`` ids and nothing is shuffled; ``at_once``
    is the encoder's.

    Returns one row per piece: ``ids`` holds the piece as little-endian
    unsigned 32-bit integers, ``start`` counts the document's ids before it,
    ``offset`` those before it in its sequence. Sequence numbers are unique
    over the job and equal on a retry of a task.

    A null or empty text is the end id alone; repeated rows and repeated or
    null doc_ids are packed row by row; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, at_once).encode
        # Reading a vocabulary leaves more behind than it keeps.
        give_back()
        end = end_id.to_bytes(ID_BYTES, "little")
        sequence = TaskContext.get().partitionId() << 33
        rests: list[tuple] = []

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*pieces)) or [()] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def close() -> pa.RecordBatch:
            nonlocal sequence
            placed = best_fit_decreasing([r[2] for r in rests], window)
            out = rows([(*r, sequence + number, offset) for r, (number, offset) in zip(rests, placed)])
            sequence += max((number for number, _ in placed), default=-1) + 1
            rests.clear()
            return out

        for batch in texts_together(batches):
            full = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                ids += end
                total, start = len(ids) // ID_BYTES, 0
                while total - start >= window:
                    part = ids[start * ID_BYTES : (start + window) * ID_BYTES]
                    full.append((doc_id, start, window, part, total, sequence, 0))
                    start, sequence = start + window, sequence + 1
                if start < total:
                    rests.append((doc_id, start, total - start, ids[start * ID_BYTES :], total))
            yield rows(full)
            if len(rests) >= together:
                yield close()
        yield close()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), PIECES)
