"""Class-sized tables inside rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_array(df: DataFrame, value: str | Column, order: str | Column | None = None) -> Column:
    """A table of at most one row per class as one array-valued scalar subquery.

    Ordered by ``order`` (or by the values). For rows that hold one value per
    class themselves, such as dense scores, or tables cut to a top-n; other
    class tables are joined.
    """
    value = F.col(value) if isinstance(value, str) else value
    if order is None:
        return df.agg(F.sort_array(F.collect_list(value)).alias("values")).scalar()
    order = F.col(order) if isinstance(order, str) else order
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return df.agg(F.transform(pairs, lambda p: p["v"]).alias("values")).scalar()
