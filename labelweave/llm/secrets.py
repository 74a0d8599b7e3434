"""Secret scans: fixed rules, and character Markov models of random strings against identifiers.

Two first-order Markov models over characters are trained from labelled
samples, one on strings that the rules found, one on ordinary words and
identifiers. A long token whose log-likelihood ratio is high is a secret too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.worker import begin, slices, tidy

# The base rules. A match that fails its least length is dropped
# after matching, so it still uses up its characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16}
KINDS = ("assign", "access", "hex", "random")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
# Every match of [0-9a-f]+ is a whole run, so runs that are too short may go unmatched.
HEX = re.compile(r"[0-9a-f]{32,}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
START = len(ALPHABET)
CODE = np.full(128, START, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(START)

SPANS = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules' matches, leftmost and without overlap in each kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def transitions(token: str) -> tuple[np.ndarray, np.ndarray]:
    """The states of ``token`` and those before them; it is made of ALPHABET."""
    to = CODE[np.frombuffer(token.encode(), dtype=np.uint8)]
    return np.concatenate([[START], to[:-1]]), to


@dataclass
class Models:
    """``ratio[a, b]``: log of how much likelier b follows a in random strings."""

    ratio: np.ndarray
    least_total: float
    least_mean: float

    def score(self, token: str) -> float:
        return float(self.ratio[transitions(token)].sum())

    def is_random(self, token: str, score: float) -> bool:
        return score >= self.least_total and score >= self.least_mean * len(token)


def _beside(matches: Iterator[re.Match], spans: list[tuple]) -> Iterator[re.Match]:
    """Those of ``matches``, which follow each other, that overlap none of ``spans`` (kind, start, end)."""
    ordered = sorted((start, end) for _, start, end in spans)
    at, reach = 0, 0
    for m in matches:
        while at < len(ordered) and ordered[at][0] < m.end():
            reach = max(reach, ordered[at][1])
            at += 1
        if reach <= m.start():
            yield m


def labelled(text: str, ordinary: bool = True) -> Iterator[tuple[int, str]]:
    """(1, value) for what the rules found in a text, (0, token) for tokens beside it unless ``ordinary`` is false."""
    spans = base_spans(text)
    for _, start, end in spans:
        last = ORDINARY.findall(text[start:end])
        if last:
            yield 1, last[-1]
    if ordinary:
        for m in _beside(ORDINARY.finditer(text), spans):
            yield 0, m[0]


def train(
    docs: DataFrame, sample_rows: int = 4000, smoothing: float = 8.0, least_total: float = 16.0, least_mean: float = 0.75, least_tokens: int = 100
) -> Models:
    """Models of labelled tokens: every value that the rules find in ``docs``, and the tokens beside them in about ``sample_rows`` documents chosen by a hash.

    Transitions are counted on the executors; the driver gets two tables of
    the alphabet's size squared. With fewer than ``least_tokens`` of either
    kind there is nothing to tell them apart by, and no token is called
    random.
    """
    n = docs.count()
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    read = docs.where(F.col("text").isNotNull()).select("text", (spread < min(1.0, sample_rows / max(n, 1))).alias("sampled"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("secrets")
        table = np.zeros((2, START + 1, START), dtype=np.int64)
        for batch in slices(batches, 1024):
            for text, sampled in zip(batch.column("text").to_pylist(), batch.column("sampled").to_pylist()):
                for label, token in labelled(text, sampled):
                    np.add.at(table[label], transitions(token), 1)
        label, before, after = np.nonzero(table)
        yield pa.record_batch([pa.array(x) for x in (label, before, after, table[label, before, after])], names=["label", "a", "b", "n"])

    counted = read.mapInArrow(tidy(count), "label bigint, a bigint, b bigint, n bigint").groupBy("label", "a", "b").agg(F.sum("n").alias("n"))
    table = np.zeros((2, START + 1, START))
    for r in counted.collect():
        table[r["label"], r["a"], r["b"]] = r["n"]
    if table[:, START].sum(axis=1).min() < least_tokens:
        return Models(np.zeros((START + 1, START)), least_total, least_mean)
    # Rare states lean on how often a character occurs at all, and that on the alphabet.
    overall = table.sum(axis=1, keepdims=True) + smoothing
    overall /= overall.sum(axis=2, keepdims=True)
    table += smoothing * START * overall
    log = np.log(table / table.sum(axis=2, keepdims=True))
    return Models(log[1] - log[0], least_total, least_mean)


def spans_of(text: str, models: Models) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; code points, end exclusive.

    The rules' spans have score 0 and all stay; a random token is added when
    it overlaps none of them.
    """
    base = base_spans(text)
    found = [(kind, start, end, 0.0) for kind, start, end in base]
    for m in _beside(TOKEN.finditer(text), base):
        score = models.score(m[0])
        if models.is_random(m[0], score):
            found.append(("random", m.start(), m.end(), score))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text), over its whole text.

    A null or empty text has no spans. Repeated rows are scanned alike; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, 1024):
            rows = [
                [dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t or "", models)]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), SPANS)


def redacted(text: str, models: Models, mark: str = "[SECRET]") -> str:
    """The text with every stretch covered by spans replaced by ``mark``."""
    out, at = [], 0
    for _, start, end, _ in spans_of(text, models):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` with secrets cut out of ``text``; null texts and other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("secrets")
        for batch in slices(batches, 1024):
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t, models) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
