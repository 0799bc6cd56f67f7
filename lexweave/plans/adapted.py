"""Queries through adapters, with their deterministic stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import adapters
from lexweave.session import table


def adjudicate_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return adapters.adjudicate(docs, "tion the").select(F.col("id").alias("doc_id"), "verdict")


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = adapters.embed(table(spark, sf_dir, "benchmark"))
    return made.select("item_id", F.size("embedding").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


QUERIES = {f.__name__: f for f in (adjudicate_fake, hash_embeddings)}
ORACLE = {
    "adjudicate_fake": "SELECT doc_id, CASE WHEN contains(lower(text), 'tion') AND contains(lower(text), 'the') THEN 'included' ELSE 'excluded' END AS verdict FROM documents",
    "hash_embeddings": "SELECT item_id, 64 AS width, 1.0::DOUBLE AS norm FROM benchmark",
}
