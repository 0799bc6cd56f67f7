"""What a model or a parser gave, checked row by row before it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators.corpus import day, number

# The kinds of regulatory values, and those that need a number.
NUMERIC_KINDS = ("threshold", "ratio", "fee", "limit", "penalty")
ENTITY_KINDS = (*NUMERIC_KINDS, "deadline", "effective_date", "requirement")
RELATIONS = ("amends", "adds_to", "supersedes", "cancels", "clarifies", "references")


def clean_entities(rows: DataFrame) -> DataFrame:
    """Entities (entity_type, metric, value_text, …) of a known kind; numeric kinds need a number, dates come from their text."""
    found = rows.withColumn("value_numeric", number(F.regexp_extract("value_text", r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)))
    found = found.withColumn("effective_date", F.when(F.col("entity_type").isin("deadline", "effective_date"), day(F.col("value_text"))))
    known = F.col("entity_type").isin(*ENTITY_KINDS) & (F.trim("metric") != "")
    return found.where(known & (~F.col("entity_type").isin(*NUMERIC_KINDS) | F.col("value_numeric").isNotNull())).withColumn("value_text", X.clip(F.col("value_text"), 500))


def valid_items(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Checklist items (item_id, text, citations) with those citations that name a block; items without any go."""
    cited = items.select("*", F.explode(F.array_distinct("citations")).alias("block_id")).join(blocks.select("block_id", "page"), "block_id")
    kept = cited.groupBy("item_id").agg(F.array_sort(F.collect_set("block_id")).alias("cited"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return items.drop("citations").join(kept, "item_id")


def valid_relations(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a known kind between two different nodes, once each, with the largest confidence."""
    known = rows.where(F.col("kind").isin(*RELATIONS) & (F.col("source_id") != F.col("target_id")))
    ids = nodes.select(F.col("id").alias("target_id")).distinct()
    return known.join(ids, "target_id", "left_semi").groupBy("source_id", "target_id", "kind").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def harvested(edges: DataFrame, anchors: DataFrame, kind: str = "clarifies", confidence: float = 0.4) -> DataFrame:
    """Edges, and weak ones for linked targets that no edge names yet; nothing links to itself."""
    pairs = anchors.select("source_id", "target_id").where("source_id <> target_id").distinct()
    new = pairs.join(edges.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")
    return edges.unionByName(new.select("source_id", "target_id", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence")))


# Fixed value: a line that only tells a page.
PAGE_NUMBER = r"(?i)^(page\s+)?[0-9]+(\s+of\s+[0-9]+)?$"


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, text): pages without the lines that many of them repeat at an edge, nor page numbers there.

    An edge is the first or last two lines that are not blank. A line up to 160
    characters goes if it stands at an edge as often as half of the pages, and
    at least three times, case aside. A word cut by a hyphen is joined to the
    line below if that begins in lower case.
    """
    plain = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), X.collapse), lambda x: x != "")
    listed = pages.select("doc", "page", plain.alias("lines"))
    ends = F.concat(F.slice("lines", 1, 2), F.slice("lines", F.greatest(F.size("lines") - 1, F.lit(1)), F.least(F.size("lines"), F.lit(2))))
    counts = listed.select("doc", F.explode(F.transform(F.filter(ends, lambda x: F.length(x) <= 160), F.lower)).alias("line")).groupBy("doc", "line").agg(F.count("*").alias("n"))
    many = pages.groupBy("doc").agg(F.greatest(F.lit(3), F.floor((F.count("*") + 1) / 2)).alias("least"))
    repeated = counts.join(many, "doc").where("n >= least").groupBy("doc").agg(F.collect_set("line").alias("repeated"))
    kept = F.filter("lines", lambda x, i: ~(((i <= 1) | (i >= F.size("lines") - 2)) & (F.coalesce(F.array_contains("repeated", F.lower(x)), F.lit(False)) | x.rlike(PAGE_NUMBER))))
    joined = F.regexp_replace(F.array_join("kept", "\n"), r"(?U)-\n(?=\p{Ll})", "")
    return listed.join(repeated, "doc", "left").withColumn("kept", kept).select("doc", "page", joined.alias("text"))


def attachment_info(url: Column) -> Column:
    """(filename, file_type) of an address."""
    name = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)$", 1)
    return F.struct(name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,5})$", 1)).alias("file_type"))
