"""Settings, sessions, workspaces, generated outputs, files and moves of tables, as merges and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of ``changes`` in place of rows of equal keys; columns are those of ``rows``."""
    return rows.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.select(*rows.columns))


def inserted(rows: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` and of ``new`` those with keys that are not there yet; of several with equal keys the first."""
    once = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return rows.unionByName(once.select(*rows.columns).join(rows.select(*keys), keys, "left_anti").select(*rows.columns))


def moved(source: DataFrame, target: DataFrame, keys: list[str], added: dict[str, Column] | None = None) -> DataFrame:
    """The target after rows of ``source`` whose keys it lacks have moved over; columns that one side lacks are null there.

    ``added`` fills new columns of the whole target where they are null.
    """
    kept = source.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    both = target.unionByName(kept, allowMissingColumns=True)
    for name, value in (added or {}).items():
        both = both.withColumn(name, F.coalesce(F.col(name), value) if name in both.columns else value)
    return both


def first_set(*values: Column) -> Column:
    """The first value that is not null and not blank, without blanks around it; null without any."""
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in values])


def settings_of(stored: DataFrame, environment: DataFrame, keys: dict[str, tuple[str, ...]], defaults: dict[str, str]) -> DataFrame:
    """(name, value, origin): each setting from the store, else the first of its variables that is set, else the default.

    Stored and environment are (key, value).
    """
    spark = stored.sparkSession
    wanted = spark.createDataFrame([(n, i, k) for n, ks in keys.items() for i, k in enumerate(ks)], "name string, n int, key string")
    set_ = lambda frame: frame.where(F.trim("value") != "").select("key", F.trim("value").alias("value"))
    variables = wanted.join(set_(environment), "key").groupBy("name").agg(F.min_by(F.struct("key", "value"), "n").alias("v"))
    names = spark.createDataFrame([(n, defaults.get(n)) for n in keys], "name string, fallback string")
    found = names.join(set_(stored).select(F.col("key").alias("name"), F.col("value").alias("own")), "name", "left").join(variables, "name", "left")
    return found.select("name", F.coalesce("own", "v.value", "fallback").alias("value"), F.when(F.col("own").isNotNull(), "stored").when(F.col("v").isNotNull(), F.col("v.key")).otherwise("default").alias("origin"))


def email(text: Column) -> Column:
    """An address in lower case without blanks around it; null if it is none."""
    plain = F.lower(F.trim(text))
    return F.when(plain.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), plain)


def pins_after(pins: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(workspace_id, id, position): a workspace's pins after some are removed and others added at the end, each once."""
    kept = pins.join(removed, ["workspace_id", "id"], "left_anti").withColumn("_new", F.lit(0))
    new = added.join(pins, ["workspace_id", "id"], "left_anti").withColumn("_new", F.lit(1))
    rows = kept.select("workspace_id", "id", "position", "_new").unionByName(new.select("workspace_id", "id", "position", "_new"))
    once = rows.groupBy("workspace_id", "id").agg(F.min(F.struct("_new", "position")).alias("at"))
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy("at", "id"))
    return once.select("workspace_id", "id", place.cast("long").alias("position"))


def without_owner(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """What goes with its owner: rows whose ``key`` no owner has any more."""
    return rows.join(owners.select(key).distinct(), key, "left_anti")


def feature_plan(targets: DataFrame, requested: list[str], have: DataFrame, features: tuple[str, ...], on_demand: tuple[str, ...] = ("checklist",), container: tuple[str, ...] = ("summary", "tags", "relationships"), force: bool = False) -> DataFrame:
    """(id, feature, target): what a generation job has to make.

    "all" means every feature but those on demand. Targets are (id, version_id,
    is_container, has_text); a container has only ``container`` features, kept on
    itself; others go to the current version, if it has text. What is in
    ``have`` (id, feature) is left out unless forced.
    """
    asked = [f for f in features if f in requested or ("all" in requested and f not in on_demand)]
    rows = targets.select("*", F.explode(F.array(*[F.lit(f) for f in asked])).alias("feature")) if asked else targets.select("*", F.lit("").alias("feature")).where(F.lit(False))
    able = F.when(F.col("is_container"), F.col("feature").isin(*container)).otherwise(F.col("version_id").isNotNull() & F.col("has_text"))
    target = F.when(F.col("is_container"), F.concat(F.lit("document:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("version:"), F.col("version_id").cast("string")))
    plan = rows.where(able).select("id", "feature", target.alias("target"))
    return plan if force else plan.join(have.select("id", "feature").distinct(), ["id", "feature"], "left_anti")


def part_summaries(parts: DataFrame) -> DataFrame:
    """(parent_id, n, summaries): labelled summaries of a container's parts in part order, of those that have one."""
    told = parts.where(F.trim(F.coalesce("summary", F.lit(""))) != "")
    item = F.struct(F.col("part_order").isNull().alias("late"), "part_order", F.col("id").alias("id"), F.concat(F.coalesce("part_label", "title"), F.lit(": "), "summary").alias("text"))
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"])
    return told.groupBy("parent_id").agg(F.count("*").alias("n"), F.array_join(listed, "\n").alias("summaries"))


def map_reduce(texts: DataFrame, limit: int, shorten: Callable[[Column], Column], reduce: Callable[[Column], Column]) -> DataFrame:
    """(id, windows, summary): each window of a text shortened, several shortened again together; one window once.

    ``shorten`` and ``reduce`` are Column functions; a model comes in as a
    pandas UDF.
    """
    from lexweave.operators.blocks import windows

    parts = texts.select("id", F.posexplode(windows(F.col("text"), limit)).alias("n", "window"))
    short = parts.select("id", "n", shorten(F.col("window")).alias("s"))
    listed = short.groupBy("id").agg(F.count("*").alias("windows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n\n").alias("joined"))
    return listed.select("id", "windows", F.when(F.col("windows") == 1, F.col("joined")).otherwise(reduce(F.col("joined"))).alias("summary"))


def manifests(parts: DataFrame) -> DataFrame:
    """(parent_id, parts, manifest): a container's version as a digest of its parts' keys, titles and hashes in order.

    A manifest changes exactly when a part comes, goes, moves or changes; levels
    of nested containers are digested from the deepest up by calling this again.
    """
    item = F.struct("position", F.concat_ws("\t", "part_key", "title", "content_hash").alias("line"))
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["line"])
    return parts.groupBy("parent_id").agg(F.count("*").alias("parts"), F.sha2(F.array_join(listed, "\n"), 256).alias("manifest"))


def nested_manifests(documents: DataFrame, depth: int = 4) -> DataFrame:
    """(document_id, content_hash) of every document: leaves keep theirs, containers digest their parts', to ``depth`` levels.

    Documents are (document_id, parent_id, part_key, title, position, content_hash).
    """
    hashes = documents.select("document_id", "content_hash")
    for _ in range(depth):
        fresh = manifests(documents.drop("content_hash").join(hashes, "document_id").where("parent_id is not null"))
        hashes = hashes.join(fresh.select(F.col("parent_id").alias("document_id"), "manifest"), "document_id", "left").select("document_id", F.coalesce("manifest", "content_hash").alias("content_hash"))
    return hashes


def family_tree(documents: DataFrame) -> DataFrame:
    """(root_id, document_id, path): every document under its root, with the part orders that lead to it.

    A chain of parents that does not end, or is longer than a dozen, is left out.
    """
    at = documents.where("parent_id is null").select(F.col("document_id").alias("root_id"), "document_id", F.array().cast("array<bigint>").alias("path"))
    found = at
    children = documents.where("parent_id is not null").select("parent_id", F.col("document_id").alias("child"), F.coalesce(F.col("part_order").cast("long"), F.lit(2**31)).alias("part_order"))
    for _ in range(12):
        at = at.join(children, at["document_id"] == children["parent_id"]).select("root_id", F.col("child").alias("document_id"), F.concat("path", F.array("part_order")).alias("path"))
        if not at.take(1):
            break
        found = found.unionByName(at)
    return found


def folded_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, container, rank, n): hits (query_id, id, rank) under their containers, at the best rank of any part."""
    own = documents.select(F.col("document_id").alias("id"), F.coalesce("parent_id", "document_id").alias("container"))
    return hits.join(own, "id").groupBy("query_id", "container").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))


def reextracted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(outcome, n): what a new extraction from kept files changes: changed, same, failed or new. Both are (id, text); a null text failed."""
    joined = stored.select("id", F.col("text").alias("old"), F.lit(True).alias("had")).join(fresh.select("id", F.col("text").alias("new"), F.lit(True).alias("has")), "id", "full_outer")
    outcome = F.when(F.col("has").isNull(), "untouched").when(F.col("new").isNull(), "failed").when(F.col("had").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def reindex_plan(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(action, sources, chunks): what a full rebuild would write, drop and leave, without doing it.

    Expected are (id, fingerprint, chunks), stored (id, fingerprint, chunks).
    """
    joined = expected.select("id", F.col("fingerprint").alias("want"), F.col("chunks").alias("new")).join(stored.select("id", F.col("fingerprint").alias("have"), F.col("chunks").alias("old")), "id", "full_outer")
    action = F.when(F.col("want").isNull(), "drop").when(F.col("have").isNull(), "write").when(F.col("want") == F.col("have"), "keep").otherwise("rewrite")
    return joined.groupBy(action.alias("action")).agg(F.count("*").alias("sources"), F.sum(F.coalesce("new", "old")).cast("long").alias("chunks"))


def ledger_repair(ledger: DataFrame, sources: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action): purge rows whose source is gone, recount rows whose chunks differ, add rows for stored sources without one.

    Ledger are (id, chunks), sources (id), stored (id, chunks).
    """
    known = sources.select("id", F.lit(True).alias("known")).distinct()
    joined = ledger.select("id", F.col("chunks").alias("said")).join(stored.select("id", F.col("chunks").alias("there")), "id", "full_outer").join(known, "id", "left")
    action = F.when(F.col("known").isNull(), F.lit("purge")).when(F.col("said").isNull(), F.lit("add")).when(~F.col("said").eqNullSafe(F.coalesce("there", F.lit(0))), F.lit("recount"))
    return joined.withColumn("action", action).where("action is not null").select("id", "action")


def cache_report(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(tree, state, prunable, n, bytes): files without rows and rows without files, by the tree they belong to.

    Files are (path, tree, bytes), expected (path, tree). A file of the archive
    is never prunable, as it may be the only copy of a replaced edition.
    """
    joined = files.join(expected.select("path", F.col("tree").alias("row_tree")).distinct(), "path", "full_outer")
    state = F.when(F.col("row_tree").isNull(), F.lit("orphan")).when(F.col("tree").isNull(), F.lit("missing"))
    found = joined.withColumn("state", state).where("state is not null").withColumn("tree", F.coalesce("tree", "row_tree"))
    return found.groupBy("tree", "state").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")).withColumn("prunable", (F.col("state") == "orphan") & (F.col("tree") != "archive"))


def usage(files: DataFrame) -> DataFrame:
    """(tree, files, bytes) of rows (path, tree, bytes)."""
    return files.groupBy("tree").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def opened(requests: DataFrame, circulars: DataFrame) -> DataFrame:
    """(request_id, id, how): a requested circular by id, else by any of its addresses in lower case, else a stub by its address.

    Requests are (request_id, asked_id, url), circulars (id, url, new_url, old_url).
    """
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), "#.*$", ""))
    urls = circulars.select("id", F.explode(F.array_distinct(F.array(plain("url"), plain("new_url"), plain("old_url")))).alias("address")).where("address is not null").groupBy("address").agg(F.min("id").alias("by_url"))
    ids = circulars.select(F.col("id").alias("asked_id"), F.col("id").alias("by_id"))
    found = requests.withColumn("address", plain("url")).join(ids, "asked_id", "left").join(urls, "address", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_url").isNotNull(), "url").when(F.col("address").isNotNull(), "stub").otherwise("none")
    return found.select("request_id", F.coalesce("by_id", "by_url").alias("id"), how.alias("how"))


def series_entries(entries: DataFrame) -> DataFrame:
    """Entries of a series index in their order, with whether a document can be summarized."""
    return entries.withColumn("can_summarize", F.coalesce(F.col("document_type").isin("pdf", "xlsx"), F.lit(False))).orderBy("position")


def editions(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """Versions asked for that may be exported: those of their document that are current; a replaced edition never is."""
    return versions.join(asked.select("version_id").distinct(), "version_id", "left_semi").where("is_current = 1")
