"""Queries over what is kept on disk and updated in parts: the positional index, chunks, vectors.

Each builds its store in the shared folder from whole tables, in several commits that
first hold wrong, missing and surplus documents, and then asks it; the SQL reads the
tables as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.functions.evidence import split_oversize
from lexweave.operators import retrieval as R
from lexweave.operators import vector_index
from lexweave.operators.kept_index import KeptIndex
from lexweave.plans import retrieval
from lexweave.session import shared_folder, table
from lexweave.sources import listing
from lexweave.sources.snapshots import SnapshotTable

SURPLUS = 1_000_000_000


def kept_index(spark: SparkSession, sf_dir: str, merge: bool = False) -> KeptIndex:
    """The documents by a first build and three batches: replaced texts, new documents, deletions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = KeptIndex(spark, shared_folder(spark, "index"))
    wrong = docs.where("doc_id % 4 <> 3").withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.reverse("text")).otherwise(F.col("text")))
    index.upsert(wrong.unionByName(docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + SURPLUS)))
    index.upsert(docs.where("doc_id % 4 = 1"))
    index.upsert(docs.where("doc_id % 4 = 3"))
    if merge:
        index.merge()
    index.delete(docs.where("doc_id % 10 = 0").select((F.col("doc_id") + SURPLUS).alias("doc_id")))
    return index


def kept_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return kept_index(spark, sf_dir).bm25(terms, "item_id", 20).withColumnRenamed("doc", "doc_id")


def kept_bm25_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the segments were merged and a batch came on top."""
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return kept_index(spark, sf_dir, True).bm25(terms, "item_id", 20).withColumnRenamed("doc", "doc_id")


def kept_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase_text"))
    return kept_index(spark, sf_dir).phrases(asked, "item_id").withColumnRenamed("doc", "doc_id")


def kept_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_index(spark, sf_dir).frequencies()


def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents whose texts changed, some of them to nothing, by two commits over a first one, compacted between."""

    def chunks(docs: DataFrame) -> DataFrame:
        words = docs.select("doc_id", X.blank_split(F.col("text")).alias("ws"))
        parts = words.select("doc_id", F.posexplode(X.chunks(F.col("ws"), 130, 30)).alias("chunk", "ws"))
        return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("ws").cast("long").alias("n_words"), F.sha2(F.array_join("ws", " "), 256).alias("content_hash"))

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = SnapshotTable(spark, shared_folder(spark, "chunks"), "doc_id")
    kept.replace(chunks(docs.withColumn("text", F.concat("text", F.lit(" old "), "text"))))
    kept.replace(chunks(docs.where("doc_id % 2 = 0")))
    kept.compact()
    odd = docs.where("doc_id % 2 = 1")
    kept.replace(chunks(odd.where("doc_id % 7 <> 0")), odd)
    return kept.read()


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by the index; a test holds them to those of all rows."""
    return vector_index.search(vector_index.index(table(spark, sf_dir, "embeddings")), _asked(spark, sf_dir), 10)


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries were asked, and whether nine in ten of their exact neighbours were found."""
    exact = R.cosine_top_k(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    met = exact.join(ivf_search(spark, sf_dir).select("query_id", "vec_id", F.lit(1).alias("found")), ["query_id", "vec_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), (F.sum("found") >= 0.9 * F.sum("hit")).alias("enough"))


def ivf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each query gets under a filter, and whether all of them pass it."""
    vectors = table(spark, sf_dir, "embeddings")
    found = vector_index.search(vector_index.index(vectors, ["label"]), _asked(spark, sf_dir), 5, "label = 1", probes=1)
    return found.join(vectors.select("vec_id", "label"), "vec_id").groupBy("query_id").agg(F.count("*").alias("n"), F.min((F.col("label") == 1).cast("long")).alias("passing"))


PAGE_ROWS = 30


def _pages(listed: DataFrame) -> Callable[[int], list[tuple]]:
    """Rows (id, url, title, day) written as the pages of a listing, newest first; the fetch of a page.

    Days are counted first, so that no task orders more than a day's rows.
    """
    per_day = listed.groupBy("day").agg(F.count("*").alias("n"))
    before = per_day.select("day", (F.sum("n").over(Window.orderBy(F.desc("day"))) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("id")) - 1
    rows = listed.join(before, "day").withColumn("place", place).withColumn("page", (F.col("place") / PAGE_ROWS).cast("long"))
    folder = shared_folder(listed.sparkSession, "pages")
    rows.repartition("page").write.partitionBy("page").parquet(folder)
    local = folder.removeprefix("file://").removeprefix("file:")

    def fetch(number: int) -> list[tuple]:
        import os

        import pyarrow.parquet as pq

        path = f"{local}/page={number}"
        if not os.path.isdir(path):
            return []
        found = pq.read_table(path, columns=["place", "id", "url", "title", "day"], partitioning=None).sort_by("place")
        return [(r["id"], r["url"], r["title"], datetime.combine(r["day"], time())) for r in found.to_pylist()]

    return fetch


def crawled_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a listing that is crawled twice, by one stream: which crawl found each.

    The second crawl goes on at the first one's mark, on a day that has got more rows since.
    """
    day = F.col("doc_id") % 400
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int")).alias("day"))
    store, mark = SnapshotTable(spark, shared_folder(spark, "crawled"), "id"), shared_folder(spark, "mark")
    kind = f"listing_{uuid.uuid4().hex}"
    for shown in (docs.where((day < 199) | ((day == 199) & (F.col("doc_id") % 800 == 199))), docs):
        spark.dataSource.register(listing.listing_source(_pages(shown.drop("doc_id")), kind))
        listing.crawl(spark, kind, shown.count() // PAGE_ROWS + 1, store, mark)
    return store.read().select(F.col("id").cast("long").alias("doc_id"), "crawl")


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as listed rows, a day each, and the two thirds of them that are stored."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("url"), F.timestamp_seconds(F.col("doc_id") * 86400 + 43200).alias("day"))
    return docs, docs.where("id % 3 <> 0")


def listing_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.availability(*_listed(spark, sf_dir))


def discovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run would fetch: listed, not stored, behind the mark."""
    return listing.new_rows(*_listed(spark, sf_dir), datetime(1970, 4, 11)).select("id")


def oversize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than 600 words in parts of 450."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_oversize(X.blank_split(F.col("text")))).alias("part", "ws"))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join("ws", " ")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (kept_bm25, kept_bm25_merged, kept_phrases, kept_frequencies, replaced_chunks, ivf_search, ivf_recall, ivf_filtered, crawled_listing, listing_availability, discovered_rows, oversize_parts)}

ORACLE = {
    "listing_availability": "SELECT count(*) AS missing, max(doc_id) AS newest, CASE WHEN count(*) > 0 THEN 'new_available' ELSE 'fresh' END AS status FROM documents WHERE doc_id % 3 = 0",
    "discovered_rows": "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 AND doc_id >= 100",
    "oversize_parts": f"""WITH w AS (SELECT doc_id, {retrieval.SPLIT} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) <= 600 THEN 1 ELSE CAST(ceil(len(ws) / 450) AS BIGINT) END)) AS part FROM w),
s AS (SELECT doc_id, part, CASE WHEN len(ws) <= 600 THEN ws ELSE ws[part * 450 + 1:part * 450 + 450] END AS ws FROM p) SELECT doc_id, part, len(ws) AS n_words, md5(array_to_string(ws, ' ')) AS text_md5 FROM s""",
    "crawled_listing": "SELECT doc_id, CASE WHEN doc_id % 400 < 199 OR doc_id % 800 = 199 THEN 0 ELSE 1 END AS crawl FROM documents",
    "kept_bm25": retrieval.ORACLE["bm25_topk"],
    "kept_bm25_merged": retrieval.ORACLE["bm25_topk"],
    "kept_phrases": retrieval.ORACLE["phrase_match"],
    "kept_frequencies": f"WITH {retrieval.POSTS} SELECT term, count(*) AS df FROM p GROUP BY 1",
    "ivf_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    "ivf_filtered": "SELECT vec_id AS query_id, least(5, (SELECT count(*) FROM embeddings WHERE label = 1)) AS n, 1 AS passing FROM embeddings WHERE vec_id % 100 = 0",
    "replaced_chunks": f"SELECT * FROM ({retrieval.ORACLE['chunk_index']}) WHERE doc_id % 2 = 0 OR doc_id % 7 <> 0",
}
