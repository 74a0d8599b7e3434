"""Files that tasks write themselves into the shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


@contextmanager
def committed(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A stream that appears under ``name`` only when the block ends well.

    It is written beside its place under a name that Spark's readers skip and
    then moved, so a task that is retried or run twice leaves one whole file.
    ``folder`` is an absolute path or a URI that ``pyarrow.fs`` knows.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    aside = f"{root}/_{name}.{os.urandom(8).hex()}"
    with store.open_output_stream(aside) as sink:
        yield sink
    store.move(aside, f"{root}/{name}")
