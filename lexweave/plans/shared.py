"""Queries that Spark and DuckDB read alike: one text, with tables in braces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.session import table


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Runs ``text`` through Catalyst over the Parquet tables it names in braces."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    return run


def duckdb_query(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
