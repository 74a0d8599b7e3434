"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Every grade shares one weight per hashed feature of the text; ordered
thresholds cut the score into grades: P(grade <= k) = sigmoid(t_k - score).
The model gives an expected grade, and the probability of the top grade for
selection.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.worker import shared, slices, tidy

SLOTS = 1 << 18
PREFIXES = (4, 5)
KNOWN_WORDS = 300_000
GRADED = ("expected_grade", "tail_probability")


def _slot(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % SLOTS


def _shape(word: str) -> str:
    """Runs of upper, lower, digit and each other character, as one sign each."""
    out = ""
    for c in word[:64]:
        sign = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if out[-1:] != sign:
            out += sign
    return out


def _word_slots(word: str) -> tuple[int, ...]:
    plain = "".join(c for c in word.lower() if c.isalnum())
    slots = [_slot("shape", _shape(word))]
    if plain:
        slots += [_slot("word", plain), *(_slot(f"start{n}", plain[:n]) for n in PREFIXES if len(plain) >= n)]
    return tuple(slots)


def features(text: str | None, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct slots of the whole text: its words, their first letters and shapes, and its make-up.

    ``known`` keeps the slots of words already seen; it starts anew when it
    is full.
    """
    words = (text or "").split()
    distinct = set(words)
    if len(known) > KNOWN_WORDS:
        known.clear()
    slots: set[int] = set()
    for word in distinct:
        found = known.get(word)
        if found is None:
            found = known[word] = _word_slots(word)
        slots.update(found)
    n = len(words)
    size = max(1, len(text or ""))
    lines = (text or "").split("\n")
    slots.add(_slot("words", n.bit_length()))
    slots.add(_slot("distinct words", f"{n.bit_length()} {10 * len(distinct) // max(1, n)}"))
    slots.add(_slot("distinct lines", f"{len(lines).bit_length()} {10 * len(set(lines)) // len(lines)}"))
    slots.add(_slot("visible", 20 * sum(map(len, words)) // size))
    return np.array(sorted(slots), dtype=np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the top grade) of scores."""
        above = 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])
        return above.sum(axis=1), above[:, -1]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows])


def solve(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int,
    epochs: int = 40, rate: float = 0.1, decay: float = 1e-3, least_share: float = 0.0025, batch: int = 64,
) -> Model:
    """Maximum likelihood by AdaGrad over shuffled batches, the same on every run.

    Slots in less than ``least_share`` of the rows, or in fewer than three,
    keep weight zero. Thresholds stay ordered because their gaps are
    exponentials.
    """
    order = np.random.default_rng(0)
    usable = np.bincount(np.concatenate(rows), minlength=SLOTS) >= max(3, least_share * len(rows))
    rows = [r[usable[r]] for r in rows]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    weights, seen, seen_free = np.zeros(SLOTS), np.full(SLOTS, 1e-8), np.full(len(free), 1e-8)

    def thresholds() -> np.ndarray:
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    for _ in range(epochs):
        for at in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            lengths = np.array([len(rows[i]) for i in at])
            slots = np.concatenate([rows[i] for i in at]) if lengths.sum() else np.empty(0, dtype=np.int64)
            owner = np.repeat(np.arange(len(at)), lengths)
            scores = np.bincount(owner, weights=weights[slots], minlength=len(at))
            cuts, y = np.concatenate([[-np.inf], thresholds(), [np.inf]]), grades[at]
            below, upto = _sigmoid(cuts[y] - scores), _sigmoid(cuts[y + 1] - scores)
            below[y == 0], upto[y == n_grades - 1] = 0, 1
            chance = np.maximum(upto - below, 1e-12)
            by_score = (1 - upto - below) / len(at)
            by_cut = np.zeros(n_grades + 1)
            np.add.at(by_cut, y + 1, -upto * (1 - upto) / chance / len(at))
            np.add.at(by_cut, y, below * (1 - below) / chance / len(at))
            gradient = np.bincount(slots, weights=by_score[owner], minlength=SLOTS)
            touched = np.nonzero(gradient)[0]
            g = gradient[touched] + decay * weights[touched]
            seen[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(seen[touched])
            tails = np.cumsum(by_cut[1:-1][::-1])[::-1]
            g = np.concatenate([tails[:1], tails[1:] * np.exp(free[1:])])
            seen_free += g * g
            free -= rate * g / np.sqrt(seen_free)
    return Model(weights, thresholds())


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of ``labels`` (doc_id, quality, toxic): 0 toxic, 1 poor, 2 good.

    Rows without doc_id or quality don't count; of several ratings of one
    document the lowest does.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    rated = labels.where("doc_id is not null and quality is not null")
    return rated.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, rated: DataFrame, n_grades: int = 3, fit_rows: int = 8000, max_fit_chars: int = 20_000) -> Model | None:
    """Learn from about ``fit_rows`` rated texts of at most ``max_fit_chars`` characters, chosen by a hash.

    ``rated`` is (doc_id, grade). The sampled ids are broadcast and the
    texts' slots reach the driver, both within those bounds. None when no
    rated document is there.
    """
    n = max(1, rated.count())
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rated.where(spread < min(1.0, fit_rows / n))
    chosen = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared("grading", "words", dict)
        for batch in slices(batches, 256):
            rows = [features(t, known) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), batch.column("grade")], names=["doc_id", "slots", "grade"]
            )

    short = chosen.where(F.coalesce(F.length("text"), F.lit(0)) <= max_fit_chars).select("doc_id", "text", F.col("grade").cast("int"))
    found = short.mapInArrow(tidy(run), "doc_id bigint, slots array<int>, grade int").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    if not found.num_rows:
        return None
    rows = [r.values.to_numpy() for r in found.column("slots")]
    return solve(rows, found.column("grade").to_numpy().astype(np.int64), n_grades)


def annotate(docs: DataFrame, model: Model | None, names: Sequence[str] = GRADED) -> DataFrame:
    """``docs`` with the expected grade and the top grade's probability as ``names``, from the whole ``text`` of each row.

    A null or empty text is graded by its empty make-up; without a model both
    are null. Repeated rows are graded alike; an empty table gives no rows;
    other columns pass through, but for those called ``names``.
    """
    names = list(names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, shared("grading", "words", dict)
        for batch in slices(batches, 256):
            expected = tail = [None] * batch.num_rows
            if model is not None:
                expected, tail = model.grades(model.scores([features(t, known) for t in batch.column("text").to_pylist()]))
            yield pa.record_batch(
                [*batch.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())],
                names=[*batch.schema.names, *names],
            )

    kept = docs.drop(*names)
    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, expected_grade, tail_probability) of every row of ``docs`` (doc_id, text); see ``annotate``."""
    return annotate(docs.select(F.col("doc_id").cast("bigint"), "text"), model).select("doc_id", *GRADED)
