"""Registry of named queries: a Spark builder and (where expressible) a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole fixture tables. Array columns are returned as '|'-joined strings so
results hash by value in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle_tables import with_tables

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_SQL: dict[str, str] = {}
_BUILDERS: dict[str, Builder] = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays to '|'-joined text (maps to sorted 'k=v' text) for comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name), "|").alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            entries = F.array_sort(F.transform(F.map_entries(F.col(f.name)),
                                               lambda e: F.concat_ws("=", e["key"], e["value"])))
            cols.append(F.array_join(entries, "|").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(key: str, sql: str | None = None):
    """Decorator: register a builder under ``key`` with its oracle SQL."""

    def deco(fn: Builder) -> Builder:
        prev = _BUILDERS.get(key)
        if prev is not None and (prev.__module__, prev.__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query key {key}")  # a module reload re-registers the same builder
        _QUERIES[key] = lambda spark, sf_dir, _fn=fn: flat(_fn(spark, sf_dir))
        _BUILDERS[key] = fn
        if sql is not None:
            _SQL[key] = with_tables(sql)
        return fn

    return deco


def queries() -> dict[str, Builder]:
    from . import (  # noqa: F401
        queries_access, queries_catalog, queries_changes, queries_directory, queries_governance, queries_metadata,
        queries_search, queries_streams,
        queries_text)

    return dict(_QUERIES)


def builders() -> dict[str, Builder]:
    """The undecorated builders (for reports)."""
    queries()
    return dict(_BUILDERS)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
