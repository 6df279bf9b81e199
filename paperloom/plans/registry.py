"""Named queries over the supplied tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
#: Worked-out cases of the same names, for the tests: (function, SQL of the expected rows).
VECTORS: dict[str, tuple[Query, str]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, and its SQL where SQL can express it."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return put


def vector(name: str, sql: str) -> Callable[[Query], Query]:
    """Keep worked-out cases of a kernel, by literal inputs and expected rows, for the tests."""

    def put(f: Query) -> Query:
        VECTORS[name] = f, sql
        return f

    return put


def queries() -> dict[str, Query]:
    from . import catalog

    catalog.load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog

    catalog.load()
    return dict(_ORACLE)
