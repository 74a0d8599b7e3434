"""Whole-text encoding with the tokenizers library, each distinct piece of a batch once.

Prose repeats its words, so a batch of texts is cut at blanks where the
byte-level pre-tokenizer always starts a new token, and each distinct piece is
encoded once. Cutting, telling pieces apart and putting the ids of texts
together are done in Arrow and numpy. The ids equal those of encoding each
text as a whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from labelweave.llm.worker import shared

BLANK_RUN = re.compile(r" (?:\s|\Z)")
# The same for Arrow, and a little wider: other separators count too.
BLANK_RUN_RE2 = r" (?:[\x09-\x0D\x1C-\x20\x{85}\pZ]|\z)"
BYTES_TOGETHER = 2_000_000


def cut(text: str) -> list[str]:
    """Pieces that start with a blank followed by something visible (but the first)."""
    head, *rest = text.split(" ")
    if not BLANK_RUN.search(text):
        return [head, *[" " + part for part in rest]]
    pieces = [head]
    for part in rest:
        if part and not part[0].isspace():
            pieces.append(" " + part)
        else:
            pieces[-1] += " " + part
    return pieces


def texts_together(batches: Iterator[pa.RecordBatch], most: int = BYTES_TOGETHER) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their ``text`` has at most ``most`` bytes, or is one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes.

    The library gets ``at_once`` strings a call, mostly of ``together`` words
    each; fewer need less memory and a little more time.
    """

    def __init__(self, path: str, together: int = 500, at_once: int = 1024):
        from tokenizers import Tokenizer

        # Every core has a task of its own; threads beside it only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Only the pre-tokenizer's settings; those of the whole tokenizer take much memory.
        splitter = self.tokenizer.pre_tokenizer
        pre = json.loads(splitter.__getstate__()) if splitter is not None else {}
        self.by_piece = (
            self.tokenizer.normalizer is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
        )
        self.together, self.at_once = together, at_once
        # In a byte-level vocabulary a token has one character for each byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        # The library's results are many times larger than the ids, so a bounded number is held at once.
        ids: list[np.ndarray] = []
        for start in range(0, len(texts), self.at_once):
            found = self.tokenizer.encode_batch_fast(texts[start : start + self.at_once], add_special_tokens=False)
            ids += [np.array(e.ids, dtype="<u4") for e in found]
        return ids

    def _words(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of all ``words``, each with a blank before it, in runs; and how many each word has.

        Words start with something visible. They are encoded many at a time
        and told apart by their bytes; where that fails, one by one.
        """
        starts = np.append(np.arange(0, len(words), self.together), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), words.cast(pa.string())), " ")
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        runs: list[np.ndarray] = []
        lengths = np.zeros(len(words), dtype=np.int64)
        for first, last, ids in zip(starts, starts[1:], self._encode([" " + text for text in joined.to_pylist()])):
            own = ends[first:last] - (ends[first - 1] if first else 0)
            reached = np.cumsum(self.width[ids])
            stops = np.searchsorted(reached, own) + 1
            if not len(ids) or not np.array_equal(reached[np.minimum(stops, len(ids)) - 1], own):
                alone = self._encode([" " + w for w in words[first:last].to_pylist()])
                ids, stops = np.concatenate(alone), np.cumsum([len(x) for x in alone])
            runs.append(ids)
            lengths[first:last] = np.diff(stops, prepend=0)
        return runs, lengths

    def _by_piece(self, texts: pa.Array) -> list[bytes]:
        uneven = pc.match_substring_regex(texts, BLANK_RUN_RE2).to_numpy(zero_copy_only=False)
        even = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
        odd = [cut(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
        odd_words = pa.array([p[1:] if n else p for row in odd for n, p in enumerate(row)], texts.type)
        words = pa.concat_arrays([even.flatten(), odd_words])
        counts = np.concatenate([np.diff(even.offsets.to_numpy()), [len(row) for row in odd]]).astype(np.int64)
        ends = np.cumsum(counts)
        is_head = np.zeros(len(words), dtype=bool)
        is_head[ends - counts] = True
        heads = self._encode(words.filter(pa.array(is_head)).to_pylist())
        coded = words.filter(pa.array(~is_head)).dictionary_encode()
        runs, lengths = self._words(coded.dictionary)
        ids = np.concatenate([*runs, *heads, np.empty(0, dtype="<u4")])
        lengths = np.concatenate([lengths, [len(x) for x in heads]]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        piece = np.empty(len(words), dtype=np.int64)
        piece[~is_head] = coded.indices.to_numpy()
        piece[is_head] = len(coded.dictionary) + np.arange(len(heads))
        out: list[bytes] = [b""] * len(texts)
        for row, start, end in zip(np.concatenate([np.flatnonzero(~uneven), np.flatnonzero(uneven)]).tolist(), (ends - counts).tolist(), ends.tolist()):
            own = piece[start:end]
            size = lengths[own]
            stop = np.cumsum(size)
            at = np.repeat(starts[own] - stop + size, size)
            at += np.arange(len(at))
            out[row] = ids[at].tobytes()
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; null is an empty text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return [ids.tobytes() for ids in self._encode(texts.to_pylist())]
        return self._by_piece(texts) if len(texts) else []


def encoder(path: str, at_once: int = 1024) -> Encoder:
    """This worker's encoder for a vocabulary file; see ``Encoder``."""
    return shared("tokens", (path, at_once), lambda: Encoder(path, at_once=at_once))
