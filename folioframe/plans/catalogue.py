"""All queries outside the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans import document_queries, general_queries, relational_queries, retrieval_queries, surface_queries

_MODULES = [general_queries, relational_queries, retrieval_queries, document_queries, surface_queries]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_queries.ret_hybrid_rrf(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
