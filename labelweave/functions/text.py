"""Text expressions. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words and what makes up a term. A word is a run
# without Unicode white space or the four ASCII information separators; a term
# is a run of at least two letters, digits or underscores.
WORD = r"(?U)[^\s\x1c-\x1f]+"
TERM = r"[\p{L}\p{N}_]{2,}"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def terms(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased terms in text order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop_words))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` tokens, each joined by one space.

    Runs of n are the runs of n - 1 zipped with the tokens n - 1 further on,
    so the work grows with the tokens and not with their square.
    """
    none = F.array().cast("array<string>")
    runs, parts = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            left = F.size(tokens) - (n - 1)
            starts = F.slice(runs, 1, F.greatest(left, F.lit(0)))
            ends = F.slice(tokens, n, F.greatest(left, F.lit(0)))
            runs = F.when(left > 0, F.zip_with(starts, ends, lambda a, b: F.concat_ws(" ", a, b))).otherwise(none)
        if n >= low:
            parts.append(runs)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def content_key(text: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def content_digest(text: Column) -> Column:
    """SHA-256 as 32 bytes, the compact grouping key for whole texts."""
    return F.unhex(F.sha2(text, 256))


def shorten(value: Column, keep: int) -> Column:
    return F.when(
        F.length(value) > keep, F.concat(F.substring(value, 1, keep), F.lit("..."))
    ).otherwise(value)


def unit_hash(seed: int, key: Column) -> Column:
    """A uniform number in [0, 1) from a seed and a key, equal on every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
