"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n from 1 to 3,
blended) that occur in both, divided by the root of the product of their
numbers of n-grams. A few training texts are landmarks; the Nyström map sends
a text to its kernel values with them times the inverse root of the landmarks'
own kernel matrix, and one-versus-rest kernel ridge regression is solved in
that space. A batch of texts is scored by two matrix products.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelweave.llm.worker import shared, slices, tidy

UNKNOWN = "und"
COMMON = 3  # so many landmarks must have a 3-gram; fewer may be texts that quote another language
LEAST_OF_USUAL = 0.75
WITH_DIGIT = re.compile(r"\S*\d\S*")
BITS = 21  # a code point fits
LAST_CODE_POINT = 0x10FFFF


def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a blank."""
    points = np.arange(LAST_CODE_POINT + 1, dtype=np.int64)
    is_letter = np.fromiter((chr(i).isalpha() for i in range(LAST_CODE_POINT + 1)), dtype=bool, count=len(points))
    points[~is_letter] = ord(" ")
    return points


def grams(text: str | None) -> np.ndarray:
    """The sorted distinct 1- to 3-grams of the whole text as integers; empty without a letter.

    Letters count in lower case; every run of other characters, and either
    end of the text, is one blank.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = shared("language", "letters", _letters)[points]
    blank = points == ord(" ")
    if blank.all():
        return np.empty(0, dtype=np.int64)
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of each run
    points = np.concatenate([[ord(" ")], points[keep], [ord(" ")]])
    if points[-2] == ord(" "):
        points = points[:-1]
    if points[1] == ord(" "):
        points = points[1:]
    three = np.unique(points[:-2] | points[1:-1] << BITS | points[2:] << 2 * BITS)
    two = np.unique(np.append(three & ((1 << 2 * BITS) - 1), points[-2] | points[-1] << BITS))
    one = np.unique(np.append(two & ((1 << BITS) - 1), points[-1]))
    return np.concatenate([one, two, three])


@dataclass
class Model:
    """Landmarks as gram sets, and a weight for each landmark and language.

    ``floors`` has for each language the share of 3-grams common among the
    landmarks below which a text is like none of its texts.
    """

    languages: list[str]
    landmarks: list[np.ndarray]
    weights: np.ndarray
    floors: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def kernel(self) -> Kernel:
        kernels = shared("language", "kernel", dict)
        if self.key not in kernels:
            kernels.clear()
            kernels[self.key] = Kernel(self.landmarks)
        return kernels[self.key]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.kernel().with_landmarks(texts) @ self.weights

    def is_like(self, texts: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
        """Whether each text's common share reaches the floors, weighted by its positive regression values."""
        total = positive.sum(axis=1)
        floors = positive @ self.floors / np.where(total > 0, total, 1)
        return (total > 0) & (self.kernel().common_share(texts) >= floors)


class Kernel:
    """Kernel values with fixed landmarks, for a batch of texts at once."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.known = np.unique(np.concatenate(landmarks))
        self.columns = self._presence(landmarks).T.copy()
        self.counts = self.columns.sum(axis=1)
        self.sizes = np.array([max(len(z), 1) for z in landmarks], dtype=np.float64)

    def _presence(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.known)), dtype=np.float32)
        for row, found in zip(out, texts):
            at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            row[at[self.known[at] == found]] = 1
        return out

    def with_landmarks(self, texts: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([max(len(t), 1) for t in texts], dtype=np.float64)
        return (self._presence(texts) @ self.columns) / np.sqrt(sizes[:, None] * self.sizes)

    def common_share(self, texts: list[np.ndarray], least: int = COMMON) -> np.ndarray:
        """The share of each text's 3-grams that at least ``least`` landmarks have."""
        known = self.known[self.counts >= least]
        out = np.zeros(len(texts))
        for i, found in enumerate(texts):
            three = found[np.searchsorted(found, 1 << 2 * BITS) :]
            if len(three) and len(known):
                at = np.minimum(np.searchsorted(known, three), len(known) - 1)
                out[i] = (known[at] == three).mean()
        return out


def solve(texts: list[np.ndarray], langs: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression of 0/1 targets per language on Nyström features."""
    languages = sorted(set(langs))
    each = max(4, landmarks // max(1, len(languages)))
    chosen: list[np.ndarray] = []
    for language in languages:
        own = {t.tobytes(): t for t, l in zip(texts, langs) if l == language}
        chosen += list(own.values())[:each]
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel.with_landmarks(chosen))
    usable = values > 1e-6 * values.max()
    inverse_root = vectors[:, usable] / np.sqrt(values[usable])
    size = inverse_root.shape[1]
    gram, moment = np.zeros((size, size)), np.zeros((size, len(languages)))
    for start in range(0, len(texts), 256):
        features = kernel.with_landmarks(texts[start : start + 256]) @ inverse_root
        target = np.array([[l == m for m in languages] for l in langs[start : start + 256]], dtype=np.float64)
        gram += features.T @ features
        moment += features.T @ target
    solved = np.linalg.solve(gram + ridge * len(texts) * np.eye(size), moment)
    return Model(languages, chosen, inverse_root @ solved, _floors(kernel, languages, chosen, texts, langs))


def _floors(kernel: Kernel, languages: list[str], chosen: list[np.ndarray], texts: list[np.ndarray], langs: list[str]) -> np.ndarray:
    """Three quarters of the common share that 99 % of each language's texts reach, a landmark by the other landmarks."""
    landmark = {z.tobytes() for z in chosen}
    shares: dict[str, list[float]] = {language: [] for language in languages}
    for start in range(0, len(texts), 256):
        part = texts[start : start + 256]
        alone, among = kernel.common_share(part), kernel.common_share(part, COMMON + 1)
        for text, language, a, b in zip(part, langs[start : start + 256], alone, among):
            shares[language].append(b if text.tobytes() in landmark else a)
    return np.array([LEAST_OF_USUAL * np.quantile(shares[language], 0.01) for language in languages])


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, fit_rows: int = 4000, max_fit_chars: int = 20_000, landmarks: int = 128) -> Model | None:
    """Learn from a bounded sample of ``docs`` (doc_id, text, lang) that isn't held out.

    About ``fit_rows`` texts of at most ``max_fit_chars`` characters reach
    the driver, as many of each language as there are, chosen by a hash. None
    when no text has a letter and a language.
    """
    usable = docs.where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_fit_chars)
        & ~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    ).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(landmarks // len(counts), fit_rows // len(counts), 4)
    shares = usable.sparkSession.createDataFrame([(l, min(1.0, each / n)) for l, n in counts.items()], "lang string, share double")
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rows = usable.join(F.broadcast(shares), "lang").where(spread < F.col("share")).select("text", "lang", spread.alias("at")).collect()
    rows.sort(key=lambda r: (r["at"], r["text"]))
    return solve([grams(r["text"]) for r in rows], [r["lang"] for r in rows], landmarks) if rows else None


def annotate(docs: DataFrame, model: Model | None, names: Sequence[str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the language and its score as ``names``, read from the whole ``text`` of each row alone.

    The score is the best language's part of the positive regression values,
    0 to 1. A text that is null or has no letter is ``und`` with score 0;
    letters that no landmark has give the first language with score 0; ties
    go to the first language by name; without a model all are ``und``.
    Repeated rows are predicted alike; an empty table gives no rows; other
    columns pass through, but for those called ``names``. A third name adds
    whether the text is like any of the languages at all, by the share of its
    3-grams that are common among the landmarks: the score can't tell, as it is high when
    a single small value is positive.
    """
    names = list(names)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, 128):
            found = [grams(t) for t in batch.column("text").to_pylist()]
            best_names, scores, like = [UNKNOWN] * len(found), np.zeros(len(found)), np.zeros(len(found), dtype=bool)
            if model is not None:
                positive = np.maximum(model.scores(found), 0)
                best = positive.argmax(axis=1)
                total = positive.sum(axis=1)
                share = positive.max(axis=1) / np.where(total > 0, total, 1)
                for i, text in enumerate(found):
                    if len(text):
                        best_names[i], scores[i] = model.languages[best[i]], share[i]
                if len(names) > 2:
                    like = model.is_like(found, positive)
                    again = np.flatnonzero(~like)  # a few words beside a key or a number are still a text
                    if len(again):
                        prose = [grams(WITH_DIGIT.sub(" ", batch.column("text")[int(i)].as_py() or "")) for i in again]
                        like[again] = model.is_like(prose, positive[again])
            judged = [pa.array(best_names, pa.string()), pa.array(scores), pa.array(like)]
            yield pa.record_batch([*batch.columns, *judged[: len(names)]], names=[*batch.schema.names, *names])

    kept = docs.drop(*names)
    added = [T.StructField(name, kind) for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return kept.mapInArrow(tidy(run), T.StructType([*kept.schema.fields, *added]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text); see ``annotate``."""
    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return annotate(narrow, model).select("doc_id", "lang_pred", F.col("lang_score").alias("score"))
