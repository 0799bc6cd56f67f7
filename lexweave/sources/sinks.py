"""Exports: CSV, Markdown transcripts and JSON, each bounded by its query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that a spreadsheet's cell holds, and what begins a formula.
CELL = 32_767
FORMULA = r"^[=+\-@\t\r]"


def cell(value: Column) -> Column:
    """Text that no spreadsheet takes for a formula, cut to a cell's length."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.left(F.when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text), F.lit(CELL))


def write_csv(hits: DataFrame, path: str, limit: int = 500) -> None:
    """The first hits as one file with a header."""
    hits.limit(limit).select(*[cell(F.col(c)).alias(c) for c in hits.columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def transcript(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, markdown): each session's messages in order; a session's messages are one document."""
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit("**\n\n"), F.trim("text"))
    rows = messages.select(session, F.struct(F.col(order), line.alias("line")).alias("m"))
    return rows.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n\n---\n\n").alias("markdown"))


def safe_filename(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit("export"))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique in order by a number before the extension."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    numbered = F.regexp_replace(F.col(name), r"(\.[A-Za-z0-9]{1,5})?$", "")
    extension = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,5})$", 1)
    return rows.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(numbered, F.lit("-"), F.col("_n").cast("string"), extension))).drop("_n")
