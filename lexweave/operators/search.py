"""Search over circulars and laws: a lexical and a semantic arm, fused by ranks, with bonuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import retrieval as R
from lexweave.operators.links import reference_search

# What ranks and agreements are worth, and the weights of columns.
RRF, TITLE, DEPARTMENT, RECENCY, REFERENCE = 60, 0.05, 0.02, 0.008, 0.5
CIRCULAR_COLUMNS = {"title": 5.0, "reference": 1.0, "body": 1.0}
LAW_COLUMNS = {"title": 4.0, "part_label": 1.0, "body": 1.0}
#: Rows of each arm that are fused.
ARM = 50


def lexical_arm(documents: DataFrame, queries: DataFrame, columns: dict[str, float], k: int = ARM) -> DataFrame:
    """(query_id, id, rank) by BM25 over weighted columns; queries are (query_id, text)."""
    return R.bm25(documents, R.query_terms(queries, "query_id", "text"), "query_id", "id", k, columns=columns).select("query_id", "id", "rank")


def semantic_arm(chunks: DataFrame, queries: DataFrame, k: int = ARM) -> DataFrame:
    """(query_id, id, rank): owners in the order in which their first chunk comes among the nearest ``k``.

    Chunks are (vec_id, id, embedding), queries (query_id, q).
    """
    near = R.cosine_top_k(chunks, queries, k).join(chunks.select("vec_id", "id"), "vec_id")
    first = near.groupBy("query_id", "id").agg(F.min("rank").alias("at"))
    return first.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long").alias("rank"))


def _part(rank: str) -> Column:
    return F.coalesce(F.lit(1.0) / (RRF + F.col(rank)), F.lit(0.0))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))


def _arms(lexical: DataFrame, semantic: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    rows = lexical.select("query_id", "id", F.col("rank").alias("lexical"), F.lit(None).cast("long").alias("semantic"), F.lit(False).alias("referenced"))
    rows = rows.unionByName(semantic.select("query_id", "id", F.lit(None).cast("long").alias("lexical"), F.col("rank").alias("semantic"), F.lit(False).alias("referenced")))
    if referenced is not None:
        none = F.lit(None).cast("long")
        rows = rows.unionByName(referenced.select("query_id", "id", none.alias("lexical"), none.alias("semantic"), F.lit(True).alias("referenced")))
    return rows.groupBy("query_id", "id").agg(F.min("lexical").alias("lexical"), F.min("semantic").alias("semantic"), F.max("referenced").alias("referenced"))


def circular_scores(circulars: DataFrame, queries: DataFrame, lexical: DataFrame, semantic: DataFrame, now: Column) -> DataFrame:
    """(query_id, id, day, score) of every candidate: both arms and the referenced circulars.

    Circulars are (id, title, reference, department, day, body), queries
    (query_id, text). Words of the query in title and department count, and
    younger circulars a little more.
    """
    candidates = _arms(lexical, semantic, reference_search(queries, circulars))
    fields = circulars.select("id", "day", X.tokens(F.coalesce("title", F.lit(""))).alias("title_words"), X.tokens(F.coalesce("department", F.lit(""))).alias("department_words"))
    words = queries.select("query_id", X.tokens(F.col("text")).alias("query_words"))
    age = F.greatest(F.datediff(now, "day") / 365.25, F.lit(0.0))
    score = _part("lexical") + _part("semantic") + F.when(F.col("referenced"), F.lit(REFERENCE)).otherwise(0.0)
    score = score + _shared(F.col("query_words"), F.col("title_words")) * TITLE + _shared(F.col("query_words"), F.col("department_words")) * DEPARTMENT
    score = score + F.coalesce(F.lit(RECENCY) / (1 + age), F.lit(0.0))
    return candidates.join(fields, "id").join(R.small_side(words, R.BROADCAST_QUERIES), "query_id").select("query_id", "id", "day", F.round(score, 8).alias("score"))


def law_scores(laws: DataFrame, queries: DataFrame, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, id, day, score): fused ranks and words of the title; a law gains nothing by its age."""
    words = queries.select("query_id", X.tokens(F.col("text")).alias("query_words"))
    fields = laws.select("id", "day", X.tokens(F.coalesce("title", F.lit(""))).alias("title_words"))
    score = _part("lexical") + _part("semantic") + _shared(F.col("query_words"), F.col("title_words")) * TITLE
    return _arms(lexical, semantic).join(fields, "id").join(R.small_side(words, R.BROADCAST_QUERIES), "query_id").select("query_id", "id", "day", F.round(score, 8).alias("score"))


def merged(parts: dict[str, DataFrame], k: int, offset: int = 0, by_date: bool = False) -> DataFrame:
    """(query_id, kind, id, score, rank): a page of each query's results over several corpora; ties go by kind and id."""
    rows = None
    for kind, part in parts.items():
        tagged = part.select("query_id", F.lit(kind).alias("kind"), "id", "day", "score")
        rows = tagged if rows is None else rows.unionByName(tagged)
    order = [F.desc_nulls_last("day")] if by_date else [F.desc("score")]
    page = R.top_k(rows, offset + k, ["query_id"], [*order, F.asc("kind"), F.asc("id")])
    return page.where(F.col("rank") > offset).select("query_id", "kind", "id", "score", "rank")


def results(page: DataFrame, evidence: DataFrame, texts: DataFrame, terms: list[str], attachments: DataFrame | None = None) -> DataFrame:
    """A page of results with what to show: the passage that matched, else a preview of the text.

    ``page`` is (query_id, id, …), evidence (query_id, id, position, text,
    source_id, page_no), texts (id, text), attachments (source_id, filename). Of
    several passages the densest in the terms is shown, ties to the first; all go
    along as ``passages``.
    """
    dense = X.let(X.blank_split(F.col("text")), lambda words: R.densest(words, terms, 25)["score"])
    ranked = evidence.where(F.coalesce(F.length("text"), F.lit(0)) > 0).withColumn("dense", F.coalesce(dense, F.lit(0).cast("long")))
    if attachments is not None:
        ranked = ranked.join(R.small_side(attachments.select("source_id", "filename"), R.BROADCAST_TERMS), "source_id", "left")
    else:
        ranked = ranked.withColumn("filename", F.lit(None).cast("string"))
    item = F.struct("position", "text", "source_id", "filename", "page_no")
    shown = ranked.groupBy("query_id", "id").agg(F.max_by(item, F.struct("dense", -F.col("position"))).alias("best"), F.sort_array(F.collect_list(item)).alias("passages"))
    preview = preview_of(F.col("text"), terms)
    joined = page.join(shown, ["query_id", "id"], "left").join(texts.select("id", preview.alias("preview")), "id", "left")
    return joined.select(*page.columns, F.coalesce("best.text", "preview").alias("snippet"), F.col("best.filename").alias("filename"), F.col("best.page_no").alias("page_no"), F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"))


def first_hit(text: Column, terms: list[str]) -> Column:
    """The 1-based place of the first of the terms in a text; 0 without any."""
    places = F.filter(F.array(*[F.instr(F.lower(text), t) for t in terms]), lambda p: p > 0)
    return F.coalesce(F.array_min(places), F.lit(0)).cast("long")


def preview_of(text: Column, terms: list[str], width: int = 25) -> Column:
    """The densest window of words, with dots where text is left out; empty for a text without words."""

    def shown(words: Column) -> Column:
        cut = lambda at: F.concat(F.when(at > 0, F.lit("…")).otherwise(""), F.array_join(F.slice(words, (at + 1).cast("int"), F.lit(width)), " "), F.when(at + width < F.size(words), F.lit("…")).otherwise(""))
        return F.when(F.size(words) == 0, F.lit("")).otherwise(X.let(R.densest(words, terms, width)["at"], cut))

    return X.let(X.blank_split(F.coalesce(text, F.lit(""))), shown)


def document_pick(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(owner, source_id, hits): of a circular's texts (owner, position, source_id, text) the one with the most distinct terms, ties to the first."""
    words = X.tokens(F.coalesce("text", F.lit("")))
    hits = F.size(F.array_intersect(F.array_distinct(words), F.array(*[F.lit(t) for t in terms])))
    return documents.withColumn("hits", hits).groupBy("owner").agg(F.max_by(F.struct("source_id", "hits"), F.struct("hits", -F.col("position"))).alias("b")).select("owner", "b.source_id", F.col("b.hits").cast("long").alias("hits"))
