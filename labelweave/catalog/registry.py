"""Registration of queries and the shared SQL building blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Each entry may use the ones it names; only what a query needs is included.
BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql.strip()


def _needed(sql: str, seen: list[str]) -> None:
    for name in BLOCKS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(BLOCKS[name], seen)
            if name not in seen:
                seen.append(name)


def compose(sql: str) -> str:
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n]})" for n in names)
    return f"WITH {parts}\n{sql.strip()}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register
