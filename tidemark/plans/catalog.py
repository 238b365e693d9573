"""Registered queries of the tape engine, each with its DuckDB SQL where SQL can express it.

A query is a function with a docstring that starts with its survey identifiers; ``register`` keeps both sides.
Doubles are rounded on both sides, as the engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql:
            _ORACLES[query.__name__] = sql
        return query

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made zero."""
    fix = lambda c: (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)
    return df.select(*(fix(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields))


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def queries() -> dict[str, Query]:
    from . import queries_factors, queries_flow, queries_sampling  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)
