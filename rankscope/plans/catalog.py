"""Query catalogue: name -> (Spark callable(spark, sf_dir) -> DataFrame, DuckDB SQL or None).

Every registered query reads whole driver tables (or data Spark derives from
them).  Doubles that come out of floating-point sums are rounded to 6 places
on both sides so engines that add in a different order still agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return deco


def _load() -> None:
    # importing the modules registers their queries
    from rankscope.plans import (builders, check_queries, comparison, evaluation, hard_queries, io_queries,  # noqa: F401
                                 quality_queries,
                                 scoring_queries, similarity_queries, text_queries)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
