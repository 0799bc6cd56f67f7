"""Links between circulars and laws: by address, by name, by part, and by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import references as REF
from lexweave.functions import titles
from lexweave.functions.evidence import mention_snippets
from lexweave.operators.corpus import contained_names
from lexweave.operators.retrieval import small_side, top_k

ADDRESS = r"(?i)https?://[^\s\"'<>()\[\]]+"
#: Characters on either side of a container's name in which a part may be cited.
PART_WINDOW = 200
# Fixed value: how a text cites a part of a document.
PART_CITED = r"(?i)\b(?:chapter|appendix|annexure|annex|schedule|part|section)\s+(?:no\.?\s*)?([0-9]{1,3}|[ivxlc]{1,6})\b"
BROADCAST_KEYS = 1_000_000


def address_key(url: Column) -> Column:
    """An address for comparison: without query, fragment, closing punctuation and closing slashes, in lower case."""
    return F.rtrim(F.lower(F.rtrim(F.regexp_replace(url, "[#?].*$", ""), F.lit(".,;:!)\"'"))), F.lit("/"))


def addresses(text: Column, hints: tuple[str, ...]) -> Column:
    """The distinct keys of a text's addresses that have one of ``hints``."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ADDRESS), F.lit(0)), address_key)
    return F.array_distinct(F.filter(found, lambda u: F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(u, h))))


def address_index(listed: DataFrame, versions: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """(address, document_id): addresses of listings (document_id, url) and of versions, which win; of equal ones the least id.

    ``drop`` are addresses that identify no document.
    """
    rows = listed.select(address_key(F.col("url")).alias("address"), F.lit(0).alias("p"), "document_id").unionByName(versions.select(address_key(F.col("url")).alias("address"), F.lit(1).alias("p"), "document_id"))
    known = rows.where(F.col("address") != "").where(~F.col("address").isin(*drop)) if drop else rows.where(F.col("address") != "")
    return known.groupBy("address").agg(F.min_by("document_id", F.struct(-F.col("p"), "document_id")).alias("document_id"))


def linked_by_address(texts: DataFrame, index: DataFrame, hints: tuple[str, ...]) -> DataFrame:
    """(id, document_id): documents whose address a text (id, text) gives."""
    asked = texts.select("id", F.explode(addresses(F.col("text"), hints)).alias("address"))
    return asked.join(small_side(index, BROADCAST_KEYS), "address").select("id", "document_id").distinct()


def name_index(documents: DataFrame) -> DataFrame:
    """(name, document_id): the names by which text may cite documents (document_id, parent_id, title) that are no parts."""
    whole = documents.where("parent_id is null").select("document_id", titles.split_title(F.col("title"))["name"].alias("title"))
    return whole.select(F.explode(titles.identifying_names(F.col("title"))).alias("name"), "document_id").distinct()


def part_index(documents: DataFrame) -> DataFrame:
    """(name, part, document_id): parts (…, parent_id, part_label) by their container's names and the number that ends their label."""
    number = F.lower(F.regexp_extract(F.trim("part_label"), r"(?i)([0-9]{1,3}|[ivxlc]{1,6})\s*$", 1))
    parts = documents.where("parent_id is not null").select("document_id", "parent_id", number.alias("part")).where("part <> ''")
    # Of parts with equal numbers the last counts.
    parts = parts.groupBy("parent_id", "part").agg(F.max("document_id").alias("document_id"))
    return name_index(documents).withColumnRenamed("document_id", "parent_id").join(parts, "parent_id").select("name", "part", "document_id")


def linked_by_name(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, document_id): documents that a text names; parts cited near a container's name stand for it.

    Texts are (id, text), documents (document_id, parent_id, title, part_label).
    """
    names = name_index(documents)
    asked = names.select(F.concat_ws("|", "document_id", "name").alias("name_id"), "name")
    met = contained_names(texts.withColumnRenamed("id", "doc_id"), asked).select(F.col("doc_id").alias("id"), F.col("name_id"))
    met = met.join(small_side(asked.join(names.select(F.concat_ws("|", "document_id", "name").alias("name_id"), "document_id"), "name_id"), BROADCAST_KEYS), "name_id").select("id", "document_id", "name")
    parts = part_index(documents)
    canonical = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    containers = met.join(small_side(parts.select("name").distinct(), BROADCAST_KEYS), "name", "left_semi").join(texts.select("id", canonical.alias("canonical")), "id")
    # The text is cut at every mention; a window is the end of one piece, the name, and the start of the next.
    pieces = F.split("canonical", F.concat(F.lit(r"\b"), F.col("name"), F.lit(r"\b")))
    window = lambda i: F.concat(F.right(F.get(F.col("pieces"), i), F.lit(PART_WINDOW)), F.lit(" | "), F.left(F.get(F.col("pieces"), i + 1), F.lit(PART_WINDOW)))
    cited = containers.withColumn("pieces", pieces).select("id", "document_id", "name", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("pieces") - 2), lambda i: F.regexp_extract_all(window(i), F.lit(PART_CITED), F.lit(1)))))).alias("part"))
    resolved = cited.withColumn("part", F.lower("part")).join(small_side(parts.withColumnRenamed("document_id", "part_id"), BROADCAST_KEYS), ["name", "part"]).select("id", "document_id", "name", "part_id").distinct()
    whole = met.join(resolved.select("id", "document_id", "name").distinct(), ["id", "document_id", "name"], "left_anti").select("id", "document_id")
    return whole.unionByName(resolved.select("id", F.col("part_id").alias("document_id"))).distinct()


def law_links(circulars: DataFrame, documents: DataFrame, index: DataFrame, hints: tuple[str, ...], have: DataFrame | None = None, attachments: DataFrame | None = None) -> DataFrame:
    """(id, document_id, detected_via): new links of circulars (id, text), by address first, then by name.

    ``attachments`` (id, url) link by their own addresses. Links in ``have``
    (id, document_id) are not repeated.
    """
    by_address = linked_by_address(circulars, index, hints)
    if attachments is not None:
        own = attachments.select("id", address_key(F.col("url")).alias("address")).join(small_side(index, BROADCAST_KEYS), "address").select("id", "document_id")
        by_address = by_address.unionByName(own).distinct()
    by_name = linked_by_name(circulars, documents).join(by_address, ["id", "document_id"], "left_anti")
    found = by_address.withColumn("detected_via", F.lit("url_scan")).unionByName(by_name.withColumn("detected_via", F.lit("name_match")))
    return found if have is None else found.join(have.select("id", "document_id").distinct(), ["id", "document_id"], "left_anti")


def law_references(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, document_id): other laws that a law's text names, without its parts, its container and itself."""
    met = linked_by_name(texts, documents)
    family = documents.select(F.col("document_id").alias("id"), F.col("document_id").alias("document_id"))
    family = family.unionByName(documents.where("parent_id is not null").select(F.col("document_id").alias("id"), F.col("parent_id").alias("document_id")))
    family = family.unionByName(documents.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("document_id").alias("document_id")))
    return met.join(family.distinct(), ["id", "document_id"], "left_anti")


def with_snippets(links: DataFrame, texts: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Links (id, document_id) to one document, with up to three excerpts around ``name`` from each text."""
    wanted = links.join(names.where(F.col("name") == name).select("document_id"), "document_id", "left_semi")
    return wanted.join(texts, "id").select("id", "document_id", mention_snippets(F.col("text"), name).alias("snippets"))


def typed_edges(links: DataFrame, verdicts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Links with the kind that a judge gave them; what has no excerpt, no verdict or an unknown kind stays "references".

    Links are (id, document_id, detected_via, snippets), verdicts (id, document_id, kind).
    """
    judged = verdicts.where(F.col("kind").isin(*kinds)).groupBy("id", "document_id").agg(F.min("kind").alias("judged"))
    asked = (F.col("detected_via") == "name_match") & (F.size("snippets") > 0)
    return links.join(judged, ["id", "document_id"], "left").select("id", "document_id", "detected_via", F.when(asked, F.coalesce("judged", F.lit("references"))).otherwise("references").alias("kind"))


def reference_search(queries: DataFrame, circulars: DataFrame, limit: int = 40) -> DataFrame:
    """(query_id, id): circulars that the first reference of a query (query_id, text) means, newest first, up to ``limit``.

    Circulars are (id, reference, title, day). Code and number must agree, and
    whether it is a letter where the query tells. An occurrence with the asked
    year counts, one with another year names another circular, and one without
    any counts if the circular is of that year. A query's year may stand anywhere in it.
    """
    first = F.get(REF.typed(F.col("text")), F.lit(0))
    year = F.regexp_extract("text", r"\b(19[0-9]{2}|20[0-9]{2})\b", 1)
    asked = queries.withColumn("r", first).where("r is not null").select("query_id", "r.code", "r.kind", "r.number", F.coalesce("r.year", F.when(year != "", year.cast("int"))).alias("asked_year"))
    spoken = F.concat(REF.typed(F.col("reference")), REF.typed(F.col("title")))
    letter = F.lower(F.concat_ws(" ", "reference", "title")).contains("letter")
    known = circulars.select("id", "day", letter.alias("letter"), F.explode(F.array_distinct(spoken)).alias("o")).select("id", "day", "letter", "o.code", "o.number", F.col("o.kind").alias("own_kind"), F.col("o.year").alias("own_year"))
    met = known.join(small_side(asked, BROADCAST_KEYS), ["code", "number"])
    kinds = F.when(F.col("kind") == "letter", F.col("letter") & (F.col("own_kind") == "letter")).when(F.col("kind") == "plain", ~F.col("letter") & ~F.coalesce(F.col("own_kind") == "letter", F.lit(False))).otherwise(F.lit(True))
    dated = F.col("own_year").isNotNull() & (F.col("asked_year").isNull() | (F.col("own_year") == F.col("asked_year")))
    undated = F.col("own_year").isNull() & (F.col("asked_year").isNull() | (F.year("day") == F.col("asked_year")))
    found = met.where(kinds & (dated | undated)).select("query_id", "id", "day").distinct()
    return top_k(found, limit, ["query_id"], [F.desc_nulls_last("day"), F.asc("id")]).select("query_id", "id")


def reference_targets(edges: DataFrame, circulars: DataFrame) -> DataFrame:
    """(source_id, text, target_id): written references resolved in the context of their source, to exactly one other circular.

    Edges are (source_id, text, content), circulars (id, reference, title, day).
    The year comes from the reference, or from where the content mentions it.
    """
    from lexweave.operators.graph import resolve

    own = F.coalesce(F.get(REF.mentions(F.col("reference")), F.lit(0)), F.get(REF.mentions(F.col("title")), F.lit(0)))
    nodes = circulars.withColumn("r", own).where("r is not null").select("id", "r.code", "r.letter", "r.number", F.coalesce("r.year", F.year("day")).alias("year"))
    asked = edges.withColumn("r", F.get(REF.mentions(F.col("text")), F.lit(0))).select("source_id", "text", "r.code", "r.letter", "r.number", REF.year_in_context(F.col("text"), F.col("content")).alias("year"), F.lit(None).cast("long").alias("target_id"))
    return resolve(asked, nodes, ["code", "letter", "number"], "year").select("source_id", "text", "target_id")


def first_per(frame: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
