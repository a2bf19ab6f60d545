"""Registry of the engine's named queries and of their reference SQL.

A query module calls ``query`` on each function; the function's name is the
query's name and ``sql`` is DuckDB SQL with the same columns.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = tuple(
    f"weftline.plans.{m}" for m in ("mining", "series", "memory", "relational", "retrieval", "graph", "rules", "streams", "catalog", "scans", "knowledge", "details")
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(name)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
