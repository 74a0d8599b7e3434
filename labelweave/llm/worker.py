"""Objects that a Python worker keeps between tasks, such as loaded tokenizers."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa


def begin(operator: str) -> types.ModuleType:
    """What this process keeps for ``operator``; objects of another one and memory they leave unused are given back.

    Package code travels by value with each task, so module globals start
    anew there; a module registered in the interpreter lasts. Workers live
    through many stages, so the objects of one operator are kept at a time.
    """
    worker = sys.modules.setdefault("_labelweave_worker", types.ModuleType("_labelweave_worker"))
    if getattr(worker, "operator", None) != operator:
        worker.operator, worker.kept = operator, {}
        give_back()
    return worker


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # What the C library keeps; others than glibc have no such call.
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker holds no freed memory: it may wait idle beside those of the next stage."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def shared(operator: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """The object that ``operator`` keeps under ``key`` in this process, made on first use."""
    worker = begin(operator)
    if key not in worker.kept:
        worker.kept[key] = make()
    return worker.kept[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, which bounds what Python holds at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
