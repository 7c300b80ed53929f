"""Query registry: a name, a function of (session, data folder), and optionally the SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MODULES = [
    "window_queries",
    "rating_queries",
    "market_queries",
    "scalar_queries",
    "quality_queries",
    "join_queries",
    "split_queries",
    "evaluation_queries",
    "aggregate_queries",
    "monitor_queries",
    "source_queries",
    "model_queries",
    "importance_queries",
    "stream_queries",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"matchspark.queries.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that sums in another order compare equal.

    The tiny shift keeps exact ties such as 0.0000125 on one side in both engines; ``rint`` stays
    in primitive arithmetic where ``round`` would build a decimal per value.
    """
    scale = f"{10**digits}D"
    return df.select(
        *[
            F.expr(f"rint((`{n}` + 1e-9D) * {scale}) / {scale} + 0D AS `{n}`") if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
