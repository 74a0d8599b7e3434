"""Token counts for context windows."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a token is a word or one mark that is neither word nor space.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\x0b\p{Z}\p{L}\p{N}_]"

# Fixed value: a classifier frames its input with a start and an end token.
CLASSIFIER_SPECIALS = 2


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column, specials: int = CLASSIFIER_SPECIALS) -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) + specials).cast("bigint")


def tokenizer_count(text: Column, load: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Counts from a real tokenizer, loaded once per Python worker.

    ``load()`` returns a function from a list of texts to their lengths.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for batch in batches:
            yield pd.Series(count(batch.tolist()), dtype="int64")

    return F.pandas_udf(run, T.LongType())(text)
