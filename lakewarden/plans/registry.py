"""Named queries of the library and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name."""

    def put(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return put


def _registered() -> dict[str, tuple[Query, str | None]]:
    """All queries; the modules that hold them register them as they are imported."""
    from lakewarden.plans import boards, detection, names, queries, streams  # noqa: F401

    return _QUERIES


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default policy does with every document."""
    return _registered()["sanitized"][0](spark, sf_dir)
