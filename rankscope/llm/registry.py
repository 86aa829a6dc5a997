"""Catalogue of the corpus queries for __spark_entry__."""

from __future__ import annotations

import corpus_pipeline

from rankscope.llm import queries as _q


def queries() -> dict:
    return _q.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _q.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
