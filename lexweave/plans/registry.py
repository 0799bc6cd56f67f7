"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.plans import adapted, corpus, deep, desk, kept, laws, layout, relational, retrieval, state

MODULES: list = [relational, retrieval, deep, corpus, adapted, laws, layout, desk, kept, state]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.ORACLE
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked retrieval for every benchmark passage."""
    return retrieval.bm25_topk(spark, sf_dir)
