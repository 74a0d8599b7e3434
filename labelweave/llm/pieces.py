"""SentencePiece models on the tokenizers library.

The model file is read as a protobuf; its normaliser, blank marker, scores,
merges and byte fallback are rebuilt as a ``tokenizers`` pipeline, which
encodes batches on one thread, as Spark runs a task per core. Ids are compared
with those of the sentencepiece library for every distinct piece of text that
is encoded.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.worker import shared, slices

MARK = "▁"  # stands for a blank in pieces

# Field numbers and enumerations of the model's protobuf.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_KIND, BYTE_FALLBACK = 3, 35
UNIGRAM, BPE = 1, 2
CHARSMAP, DUMMY_PREFIX, SQUEEZE, ESCAPE = 2, 3, 4, 5

TOGETHER = 64  # new cuts that go through both libraries in one string

ENCODED = "doc_id bigint, ids binary, n_tokens bigint, parity boolean, round_trip boolean"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def protobuf_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) in file order; fixed-width values come as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} in a SentencePiece model")
            value, at = data[at : at + size], at + size
        yield number, value


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @classmethod
    def parse(cls, data: bytes) -> Spec:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in protobuf_fields(data):
            if number == PIECE:
                f = dict(protobuf_fields(value))
                pieces.append((f[PIECE_TEXT].decode(), struct.unpack("<f", f.get(PIECE_SCORE, bytes(4)))[0], f.get(PIECE_KIND, NORMAL)))
            elif number == TRAINER:
                trainer = dict(protobuf_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(protobuf_fields(value))
        return cls(
            pieces, trainer.get(MODEL_KIND, UNIGRAM), bool(trainer.get(BYTE_FALLBACK, 0)), normalizer.get(CHARSMAP, b""),
            bool(normalizer.get(DUMMY_PREFIX, 1)), bool(normalizer.get(SQUEEZE, 1)), bool(normalizer.get(ESCAPE, 1)),
        )

    def unknown_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which they merge: by the score of what they make.

        Pieces of one score merge from the left, so a run that has grown
        takes its next neighbour before another pair starts.
        """
        mergeable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                for cut in range(1, len(piece)):
                    a, b = piece[:cut], piece[cut:]
                    if a in mergeable and b in mergeable:
                        found.append((-score, -len(a), mergeable[a], mergeable[b], a, b))
        return [(a, b) for *_, a, b in sorted(found)]

    def splits_at_blanks(self) -> bool:
        """No piece has a blank after something else, so no merge crosses the start of a run of blanks."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def backend(spec: Spec):
    """The ``tokenizers.Tokenizer`` that encodes and decodes like the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    unknown = spec.pieces[spec.unknown_id()][0]
    if spec.kind == BPE:
        model = models.BPE(
            vocab=vocabulary, merges=spec.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback
        )
    elif spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=spec.unknown_id(), byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"SentencePiece model kind {spec.kind} is neither unigram nor BPE")
    built = Tokenizer(model)
    own = [AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER_DEFINED]
    if own:
        built.add_tokens(own)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    blank = MARK if spec.escape else " "
    steps += [normalizers.Prepend(blank)] if spec.dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)] if spec.escape else []
    if steps:
        built.normalizer = normalizers.Sequence(steps)
    if spec.escape and spec.splits_at_blanks():
        built.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    built.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []))
    return built


class Codec:
    """A model in both libraries, and the pieces of text already encoded.

    Where the model splits at blanks and leaves the text as it is, a text is
    cut there and each distinct cut is encoded, checked and decoded once. When
    more than ``keep`` cuts are in memory, all are dropped.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            spec = Spec.parse(f.read())
        self.tokenizer = backend(spec)
        self.theirs = SentencePieceProcessor(model_file=path)
        self.by_cut = spec.splits_at_blanks() and spec.dummy_prefix and spec.escape and not spec.squeeze and not spec.charsmap
        self.starts = np.array([p.startswith(MARK) for p, _, _ in spec.pieces])
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.failed: dict[str, tuple[bool, bool]] = {}  # known cuts for which a check doesn't hold

    def check(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids, equal to the other library's, decoded to the text) of each text."""
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.theirs.encode(texts, num_threads=1)
        back = self.tokenizer.decode_batch(ours, skip_special_tokens=False)
        return [
            (np.array(a, dtype="<u4").tobytes(), a == b, c == t.replace(MARK, " "))
            for a, b, c, t in zip(ours, theirs, back, texts)
        ]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        if not self.by_cut:
            return self.check(texts)
        if len(self.known) > self.keep:
            self.known.clear()
            self.failed.clear()
        cuts = [self.cut(t) for t in texts]
        self.learn(set().union(*cuts).difference(self.known))
        out = []
        for own in cuts:
            failed = [self.failed[c] for c in own if c in self.failed] if self.failed else []
            ids = b"".join(map(self.known.__getitem__, own))
            out.append((ids, all(f[0] for f in failed), all(f[1] for f in failed)))
        return out

    def learn(self, fresh: set[str]) -> None:
        """Encode and check new cuts, those without blanks and markers many to a string.

        The ids of such a cut start at its only marked piece. A string for
        which that or a check doesn't hold gives its cuts to be done alone.
        """
        plain = [c for c in fresh if " " not in c and MARK not in c]
        alone = list(fresh.difference(plain))
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for own, (ids, parity, back) in zip(groups, self.check([" ".join(g) for g in groups])):
            at = (4 * np.flatnonzero(self.starts[np.frombuffer(ids, dtype="<u4")])).tolist()
            if parity and back and len(at) == len(own):
                self.known.update((c, ids[a:b]) for c, a, b in zip(own, at, at[1:] + [len(ids)]))
            else:
                alone += own
        for c, (ids, parity, back) in zip(alone, self.check(alone)):
            self.known[c] = ids
            if not (parity and back):
                self.failed[c] = parity, back

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text without one blank at each cut; encoding puts the blank back as its dummy prefix."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        # Blanks at the very end stay with what stands before them.
        marked = MARK + text.replace(" ", MARK)
        return [c[1:] for c in re.findall(rf"{MARK}+[^{MARK}]+(?:{MARK}+\Z)?", marked)] or [text]


def codec(path: str) -> Codec:
    """This worker's codec for a model file."""
    return shared("pieces", path, lambda: Codec(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Ids of every row of ``docs`` (doc_id, text) as little-endian unsigned 32-bit integers.

    ``parity`` tells whether the sentencepiece library gives the same ids,
    ``round_trip`` whether they decode to the text (in which the marker
    counts as a blank). A null or empty text has no ids, and both hold.
    Repeated rows are encoded alike; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = codec(model).encode([t or "" for t in batch.column("text").to_pylist()])
            ids, parity, back = (list(c) for c in zip(*found))
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(parity, pa.bool_()), pa.array(back, pa.bool_()),
                ],
                names=["doc_id", "ids", "n_tokens", "parity", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) as ``encode`` gives them; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            ids = [np.frombuffer(i or b"", dtype="<u4").tolist() for i in batch.column("ids").to_pylist()]
            texts = codec(model).tokenizer.decode_batch(ids, skip_special_tokens=False)
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
