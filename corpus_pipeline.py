"""The corpus pipeline: from raw documents to packed sequences, one operator to a stage.

Every stage reads all rows that the one before it kept; all but the last return
the columns of ``documents``. Models are fitted on the rows of the stage's own
input, except those that the operators' own queries hold out.

Edge cases, of every stage: no rows give no rows; a text of any length is read
whole; columns beside those of ``documents`` pass through the stages but the last,
also those with an operator's own names; repeated rows are judged each and alike,
so that all of them stay or go, and rows of one doc_id are one document for near
copies, all of whose rows stay or go; a null doc_id is a document that copies
none; ties go to the smaller doc_id or, of languages, to the first in order. A
null or empty text has no language and goes at the first stage; the others keep
it, without lines, links or tokens but the end.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import langid, line_dedup, minhash_forest, packing, quality
from lexweave.llm.common import documents, written
from lexweave.llm.queries import remainder

#: A document goes if its language has no letter to tell it by, or a score under this.
LANGUAGE_SCORE = 0.5
#: A document goes if low quality is likelier than high quality.
QUALITY_SCORE = 0.5
SHINGLE_WORDS = 5


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``und`` and unsure ones go."""
    model = langid.train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    predicted, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.identify(docs, model, output=predicted, score=score)
    return found.where((F.col(predicted) != langid.UNKNOWN) & (F.col(score) >= LANGUAGE_SCORE)).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier of high than of low quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, lambda doc_id: remainder(doc_id, 4) == 2)
    score = fresh(docs, "quality_score")
    return quality.score(docs, model, output=score).where(F.col(score) >= QUALITY_SCORE).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line nearly equals; ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs)
    if "n_chars" in found.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    found = minhash_forest.near_duplicates(docs.select("doc_id", "text"), SHINGLE_WORDS)
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("quality classifier", quality_filter),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("best-fit packing", packed),
]

#: No SQL expresses the models and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
