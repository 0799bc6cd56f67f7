"""Queries over settings, workspaces, sessions, conversations, generated outputs, inventories and kept files.

Orders, customers and line items stand for jobs, users and outputs, as in the
other plans; the SQL beside each says what it means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import admin as A
from lexweave.operators import chat as CH
from lexweave.operators import corpus as C
from lexweave.operators import inventory as I
from lexweave.operators import validation as V
from lexweave.plans.relational import Tables


def _s(x: Column) -> Column:
    return x.cast("string")


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.customer.select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    changes = t.customer.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new-"), "c_name")).alias("key"), F.lit("changed").alias("value"))
    return A.merged(rows, changes, ["key"])


def settings_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    stored = t.region.select(F.lower("r_name").alias("key"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit(" v"), _s(F.col("r_regionkey")))).otherwise(" ").alias("value"))
    environment = t.nation.select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 4 != 3, F.concat(F.lit("e"), _s(F.col("n_nationkey")))).otherwise("").alias("value"))
    keys = {"africa": ("NATION_9",), "america": ("NATION_3", "NATION_8"), "asia": (), "europe": ("NATION_3",), "nowhere": ("NATION_9", "NATION_7")}
    return A.settings_of(stored, environment, keys, {"europe": "far", "nowhere": "none"})


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    made = F.when(k % 3 == 0, F.concat(F.lit(" User"), _s(k), F.lit("@Example.ORG "))).when(k % 3 == 1, F.concat(F.lit("user"), _s(k), F.lit("@host"))).otherwise(F.concat(F.lit("a b"), _s(k), F.lit("@x.yz")))
    return Tables(spark, sf_dir).customer.select("c_custkey", A.email(made).alias("email"))


def workspace_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pins of orders: returned ones are removed, and each order gets two more, of which one may be there."""
    t = Tables(spark, sf_dir)
    pins = t.lineitem.groupBy(F.col("l_orderkey").alias("workspace_id"), F.col("l_partkey").alias("id")).agg(F.min("l_linenumber").alias("position"))
    removed = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("workspace_id"), F.col("l_partkey").alias("id")).distinct()
    added = t.lineitem.select(F.col("l_orderkey").alias("workspace_id"), F.explode(F.array(F.lit(-1).cast("long"), F.col("l_partkey"))).alias("id")).withColumn("position", F.lit(1)).distinct()
    return A.pins_after(pins, added, removed)


def orphaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return A.without_owner(t.conversations.select(F.col("conv_id").alias("doc_id"), "turn"), t.labels, "doc_id").withColumnRenamed("doc_id", "conv_id")


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: a session is its user's own where their numbers agree modulo 5."""
    t = Tables(spark, sf_dir)
    e = F.col("event_id")
    requests = t.events.select(e.alias("request_id"), F.concat(F.lit("s"), _s(e % 4000)).alias("session_id"), (e % 5).alias("user_id"))
    sessions = t.customer.select(F.concat(F.lit("s"), _s(F.col("c_custkey"))).alias("session_id"), (F.col("c_custkey") % 3).alias("user_id"))
    return CH.sessions_for(requests, sessions)


def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = F.col("doc_id")
    targets = t.documents.select(d.alias("id"), F.when(d % 4 != 0, d * 10).alias("version_id"), (d % 7 == 0).alias("is_container"), (F.col("n_chars") >= 300).alias("has_text"))
    have = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "summary").otherwise("tags").alias("feature"))
    return A.feature_plan(targets, ["all", "entities"], have, ("summary", "tags", "checklist", "entities", "relationships"))


def part_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = Tables(spark, sf_dir).part.select((k % 20).alias("parent_id"), k.alias("id"), F.when(k % 3 != 0, k % 11).alias("part_order"), F.when(k % 2 == 0, F.concat(F.lit("Chapter "), _s(k))).alias("part_label"), F.col("p_name").alias("title"), F.when(k % 5 != 0, F.col("p_type")).otherwise(" ").alias("summary"))
    return A.part_summaries(parts).select("parent_id", "n", F.md5("summaries").alias("summaries_md5"))


def mapped_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 3,000 characters, each shortened to its first 40, and these together to 100."""
    texts = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return A.map_reduce(texts, 3000, lambda w: F.left(w, F.lit(40)), lambda j: F.left(j, F.lit(100)))


def container_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = Tables(spark, sf_dir).part.select((k % 20).alias("parent_id"), k.alias("position"), _s(k).alias("part_key"), F.col("p_name").alias("title"), F.sha2("p_type", 256).alias("content_hash"))
    return A.manifests(parts)


def _tree(t: Tables) -> DataFrame:
    """Parts as a tree: each number's parent is a third of it."""
    k = F.col("p_partkey")
    return t.part.select(k.alias("document_id"), F.when(k > 2, F.floor(k / 3)).alias("parent_id"), _s(k).alias("part_key"), F.col("p_name").alias("title"), k.alias("position"), F.when(k % 2 == 0, (k % 3)).alias("part_order"), F.md5("p_name").alias("content_hash"))


def nested_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests over two levels of containers."""
    return A.nested_manifests(_tree(Tables(spark, sf_dir)), 2)


def family_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.family_tree(_tree(Tables(spark, sf_dir)))
    return found.select("root_id", "document_id", F.size("path").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def folded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    hits = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("long").alias("rank"))
    return A.folded_hits(hits, _tree(t))


def reextraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents extracted anew; every tenth comes under an id that no document has."""
    t = Tables(spark, sf_dir)
    d = F.col("doc_id")
    fresh = t.documents.where("doc_id % 10 <> 9").select(F.when(d % 10 == 8, -1 - d).otherwise(d).alias("id"), F.when(d % 10 == 0, F.lit(None)).when(d % 10 == 1, F.upper("text")).otherwise(F.col("text")).alias("text"))
    return A.reextracted(t.documents.select(d.alias("id"), "text"), fresh)


def reindex_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild over an index in which some documents are missing, some stand under ids that no document has, and some have older texts."""
    t = Tables(spark, sf_dir)
    expected = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), X.chunk_count(F.size(X.blank_split(F.col("text"))), 350, 75).alias("chunks"))
    stored = t.documents.where("doc_id % 6 <> 0").select(F.when(F.col("doc_id") % 6 == 1, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("id"), F.sha2(F.when(F.col("doc_id") % 6 == 2, F.lower("text")).otherwise(F.col("text")), 256).alias("fingerprint"), F.lit(2).cast("long").alias("chunks"))
    return A.reindex_plan(expected, stored)


def ledger_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ledger = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("chunks"))
    stored = t.documents.where("doc_id % 4 <> 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 4 == 1, 5000).otherwise(0)).alias("id"), (F.col("doc_id") % 5).alias("chunks"))
    sources = t.documents.where("doc_id % 3 <> 0").select(F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 5000)).alias("id"))
    return A.ledger_repair(ledger, sources, stored)


def _trees(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    tree = F.get(F.array(F.lit("html"), F.lit("attachments"), F.lit("archive")), (d % 3).cast("int"))
    path = F.concat(tree, F.lit("/"), _s(d))
    return t.documents.where("doc_id % 5 <> 0").select(path.alias("path"), tree.alias("tree"), F.col("n_chars").alias("bytes")), t.documents.where("doc_id % 4 <> 0").select(path.alias("path"), tree.alias("tree"))


def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cache_report(*_trees(Tables(spark, sf_dir)))


def disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage(_trees(Tables(spark, sf_dir))[0])


def opened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    p = F.col("page_id")
    known = t.pages.where("page_id % 3 <> 0").select(p.alias("id"), F.upper("url").alias("url"), F.concat(F.lit("https://new.org/"), _s(p)).alias("new_url"), F.lit(None).cast("string").alias("old_url"))
    asked = t.pages.select(p.alias("request_id"), F.when(p % 4 == 0, p).alias("asked_id"), F.when(p % 4 == 1, F.concat(F.lit("https://NEW.org/"), _s(p), F.lit("#top"))).when(p % 4 != 3, F.concat(F.lit("https://none.org/"), _s(p))).alias("url"))
    return A.opened(asked, known)


def moved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels move to a table that has some of them already, and a new column is filled."""
    t = Tables(spark, sf_dir)
    target = t.labels.where("doc_id % 2 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit("kept").alias("note"))
    return A.moved(t.labels.select("doc_id", "quality"), target, ["doc_id"], {"note": F.lit("moved"), "era": F.lit("new")})


def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    have = t.orders.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey")
    return A.inserted(have, t.orders.where("o_orderkey % 3 = 1").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")])


def current_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    versions = t.orders.select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderstatus") == "O").cast("int").alias("is_current"))
    return A.editions(versions, t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("version_id")))


def provider_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 7 == 0, F.lit(429)).when(e % 7 == 1, F.lit(403)).when(e % 7 == 2, F.lit(503))
    said = F.get(F.array(F.lit("Model not found"), F.lit("Connection REFUSED"), F.lit("quota exceeded"), F.lit("Overloaded"), F.lit("odd")), (e % 5).cast("int"))
    return Tables(spark, sf_dir).events.select("event_id", CH.provider_state(status, said).alias("state"))


def batch_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each document, which fails for every ninth; labelled ones are skipped."""
    t = Tables(spark, sf_dir)

    def call(row: dict) -> str:
        if row["doc_id"] % 9 == 0:
            raise ValueError(f"bad {row['doc_id']}")
        return f"{row['doc_id']}:{len(row['text'])}"

    rows = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.lit(True).alias("have")), "doc_id", "left")
    return CH.batch_calls(rows, call, F.coalesce("have", F.lit(False))).select("doc_id", "output", "error")


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = F.col("conv_id")
    said = F.concat("text", F.lit(" [[circular:"), _s(c), F.lit("|A]] and [[law:"), _s(F.col("turn")), F.lit("]] [[x:1]]"))
    answers = t.conversations.where("role = 'assistant'").select((c * 1000 + F.col("turn")).alias("answer_id"), said.alias("text"))
    known = t.documents.where("doc_id % 2 = 0").select(F.lit("circular").alias("kind"), _s(F.col("doc_id")).alias("id"))
    return CH.unresolved_citations(answers, known)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts of an answer: empty ones are none, and an error ends it."""
    k = F.col("turn")
    parts = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("session"), k.alias("position"), F.when(k % 4 == 2, "").otherwise(F.concat(F.lit("part "), _s(k))).alias("text"), F.when((F.col("conv_id") % 3 == 0) & (k == 3), F.lit("lost")).alias("error"))
    found = CH.events_of(parts)
    return found.select("session", "position", "event", F.md5(CH.sse(F.col("event"), F.col("data"))).alias("wire_md5"))


def context_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = F.col("doc_id")
    circulars = t.documents.select(d.alias("id"), F.concat(F.lit("C"), _s(d)).alias("label"), "source", F.lit("T").alias("title"), F.when(d % 2 == 0, F.col("source")).alias("department"), F.when(d % 3 == 0, F.lit("2024-01-01")).alias("day"), F.lit(None).cast("string").alias("url"))
    k = F.col("turn")
    files = t.conversations.select(F.col("conv_id").alias("owner"), k.alias("attachment_id"), F.concat(F.when(k % 2 == 0, "b").otherwise("A"), _s(k), F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("file_type"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("status"), (k > 0).alias("has_text"), (k > 1).alias("indexed"))
    return CH.manifest(circulars, files).select("id", F.md5("manifest").alias("manifest_md5"))


def direct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that fit whole into 300 tokens."""
    rows = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), "text")
    return CH.direct_documents(rows, 300).select("session", "position", "tokens")


def budgeted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), "text")
    return CH.within_budget(rows, 120, ["zzz"]).select("query_id", "rank", F.length("text").cast("long").alias("chars"))


def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), F.concat(F.lit("[["), _s(F.col("turn")), F.lit("]]")).alias("citation"), "text", F.concat(F.lit("m"), _s(F.col("turn"))).alias("manifest"))
    found = CH.context(rows, rows.where("position = 1"), rows.where("position = 2"))
    return found.select("session", F.md5("context").alias("context_md5"))


def document_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.operators.search import document_pick

    rows = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("owner"), F.col("turn").alias("position"), _s(F.col("turn")).alias("source_id"), "text")
    return document_pick(rows, ["of", "und", "que", "dans", "der", "en", "la", "est"])


def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, here the German ones, ranked for each passage by words alone."""
    t = Tables(spark, sf_dir)
    chunks = t.documents.where("lang = 'de'").select(F.col("doc_id").alias("id"), "text")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("BPRD Circular No. 5 "), "text").alias("text"))
    return CH.scoped_passages(chunks, asked, None)


def term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    queries = t.region.select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("text"))
    near = t.nation.select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("the of").alias("text"))
    made = t.customer.select((F.col("c_custkey") % 5).cast("int").alias("query_id"), F.col("c_custkey").alias("position"), F.when(F.col("c_custkey") % 3 == 0, F.lit("nation_2")).otherwise(F.concat(F.lit("Term "), _s(F.col("c_custkey")))).alias("text"))
    return I.term_sets(queries, near, made)


def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of terms in answers that name their field otherwise, or not at all."""
    e = F.col("event_id")
    made = F.when(e % 4 == 0, '{"terms": ["a", "b"], "x": ["c"]}').when(e % 4 == 1, '{"search_terms": ["d"], "n": 1}').when(e % 4 == 2, '{"p": ["a"], "q": ["b"]}').otherwise('{"n": 2}')
    return Tables(spark, sf_dir).events.select("event_id", F.array_join(I.list_field(made, "terms"), "|").alias("terms"))


def inventory_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates with vectors as chunks: up to two passages each, spans where they are verified."""
    t = Tables(spark, sf_dir)
    d = F.col("doc_id")
    candidates = t.documents.select(d.alias("key"), F.lit("circular").alias("kind"), (d % 2).alias("lexical"), (d % 10 / 10).alias("score"), F.array(d, d + 1000000, d + 100).alias("chunk_ids"))
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), _s(F.col("vec_id") % 7).alias("source_id"), F.lit("L").alias("label"), F.concat(F.lit("passage "), _s(F.col("vec_id"))).alias("text"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 9).alias("page"), F.when(F.col("vec_id") % 4 == 1, F.col("vec_id")).alias("offset"))
    spans = t.embeddings.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("span "), _s(F.col("vec_id"))).alias("span"), (F.col("vec_id") % 3 == 1).alias("verified"))
    found = I.results(candidates, chunks, t.documents.select(d.alias("key"), F.col("source").alias("title")), 3, spans)
    rows = I.evidence_rows(found)
    return rows.select("key", "title", F.col("n").cast("long").alias("n"), "text", "verified", "locator")


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    sources = C.scope(t.documents, {"external": F.col("doc_id") % 11 == 0}, {"short": F.length("text") < 300}).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("expected"), "excluded", "unsearchable")
    ledger = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("stored"))
    return I.index_status(sources, ledger)


def fingerprint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    recorded = t.embeddings.select(F.concat(F.lit("model-"), _s(F.col("label") % 3)).alias("fingerprint"), (F.size("embedding") + F.col("label") % 2).alias("width"))
    return I.fingerprint_mismatch(recorded, "model-1", 64)


def clean_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k = F.col("l_orderkey")
    rows = t.lineitem.select(k.alias("id"), "l_linenumber", F.get(F.array(*[F.lit(x) for x in ("ratio", "deadline", "requirement", "gossip", "fee")]), (k % 5).cast("int")).alias("entity_type"), F.when(k % 7 == 0, " ").otherwise("m").alias("metric"), F.when(k % 5 == 1, F.concat(F.lit("2024-05-"), F.lpad(_s(k % 28 + 1), 2, "0"))).when(k % 3 == 0, F.lit("many")).otherwise(F.concat(F.lit("Rs 1,"), F.lpad(_s(k % 1000), 3, "0"), F.lit(".5"))).alias("value_text"))
    found = V.clean_entities(rows)
    return found.select("id", "l_linenumber", "entity_type", "value_numeric", _s(F.col("effective_date")).alias("day"))


def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    k = F.col("o_orderkey")
    items = t.orders.select(k.alias("item_id"), F.lit("x").alias("text"), F.array(_s(k % 50), _s(k % 7), _s(k % 50)).alias("citations"))
    listed = t.part.where("p_size > 25").select(_s(F.col("p_partkey")).alias("block_id"), (F.col("p_partkey") % 6).alias("page"))
    return V.valid_items(items, listed).select("item_id", F.array_join("cited", ",").alias("cited"), "page_start", "page_end")


def valid_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.edges.withColumn("confidence", F.when(F.col("source_id") % 2 == 0, (F.col("source_id") % 10) / 10))
    both = rows.unionByName(rows.withColumn("confidence", F.lit(0.5))).unionByName(rows.withColumn("source_id", F.col("target_id")))
    return V.valid_relations(both, t.documents.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id")))


def harvested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    edges = t.edges.select("source_id", "target_id", "kind", F.lit(0.9).alias("confidence"))
    anchors = t.documents.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 90).alias("target_id"))
    return V.harvested(edges, anchors)


def attachment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    made = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/File"), _s(p), F.when(p % 3 == 0, ".PDF").when(p % 3 == 1, ".xlsx#x").otherwise("?a=b.pdf"))
    found = V.attachment_info(made)
    return Tables(spark, sf_dir).pages.select("page_id", found["filename"].alias("filename"), found["file_type"].alias("file_type"))


def stale_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.functions.evidence import stale_chain

    t = Tables(spark, sf_dir)
    members = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("now"))
    rows = members.withColumn("stored", F.when(F.col("l_orderkey") % 3 == 0, F.reverse("now")).when(F.col("l_orderkey") % 3 == 1, F.col("now")))
    return rows.select("l_orderkey", stale_chain(F.col("l_orderkey") % 10 == 0, F.col("stored"), F.col("now")).alias("stale"))


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered questions read from a page of them, written by rule from the passages."""
    t = Tables(spark, sf_dir)
    page = t.benchmark.groupBy((F.col("item_id") % 4).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: F.concat(F.lit("**Q"), _s(x["item_id"]), F.lit(".** "), F.translate(F.substring(x["text"], 1, 30), "\n", " "), F.lit("\nnote"))), "\n").alias("markdown"))
    from lexweave.functions.markup import questions

    return page.select("page", F.explode(questions(F.col("markdown"))).alias("q")).select("page", "q.key", "q.question")


def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events against the newest of all: how far behind each is."""
    t = Tables(spark, sf_dir)
    newest = t.events.agg(F.max("event_id").alias("newest"))  # one row
    own = t.events.groupBy("user_id").agg(F.max("event_id").alias("last"), F.count("*").alias("n"))
    return own.crossJoin(F.broadcast(newest)).select("user_id", "n", (F.col("newest") - F.col("last")).alias("behind"))


def latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's interrupted jobs: events after their last click that are no views."""
    t = Tables(spark, sf_dir)
    last = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("user_id"))
    rows = t.events.withColumn("last_click", last).where("event_type <> 'view' and (last_click is null or event_id > last_click)")
    return rows.groupBy("user_id").agg(F.count("*").alias("interrupted"))


QUERIES = {
    f.__name__: f
    for f in (
        settings_merge, settings_resolved, emails, workspace_pins, orphaned_rows, chat_sessions, generation_plan, part_rollup, mapped_summaries, container_manifests, nested_manifests, family_tree, folded_hits, reextraction,
        reindex_preview, ledger_repairs, cache_report, disk_usage, opened_documents, moved_tables, inserted_rows, current_editions, provider_states, batch_outputs, answer_citations, stream_events, context_manifests,
        direct_texts, budgeted_passages, chat_context, document_picks, scoped_search, term_sets, answer_fields, inventory_results, index_state, fingerprint_check, clean_entities, valid_items, valid_relations,
        harvested_edges, attachment_names, stale_chains, benchmark_questions, index_audit, latest_of_each,
    )
}

TREE = "SELECT p_partkey AS k, CASE WHEN p_partkey > 2 THEN p_partkey // 3 END AS parent, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 END AS ord FROM part"
SPLIT = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
FILES = "SELECT ['html', 'attachments', 'archive'][doc_id % 3 + 1] AS tree, doc_id, n_chars FROM documents"


def _tok(column: str) -> str:
    from lexweave.plans.retrieval import tok

    return tok(column)


ORACLE = {
    "settings_merge": "SELECT c_name AS key, CASE WHEN c_custkey % 6 = 0 THEN 'changed' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 'new-' || c_name, 'changed' FROM customer WHERE c_custkey % 6 = 3",
    "settings_resolved": "SELECT * FROM (VALUES ('africa', 'v0', 'stored'), ('america', 'e8', 'NATION_8'), ('asia', 'v2', 'stored'), ('europe', 'far', 'default'), ('nowhere', 'e9', 'NATION_9')) t(name, value, origin)",
    "emails": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'user' || c_custkey || '@example.org' END AS email FROM customer",
    "workspace_pins": """WITH p AS (SELECT l_orderkey AS workspace_id, l_partkey AS id, min(l_linenumber) AS position, bool_or(l_returnflag = 'R') AS gone FROM lineitem GROUP BY 1, 2),
r AS (SELECT workspace_id, id, 0 AS late, position FROM p WHERE NOT gone UNION ALL SELECT DISTINCT l_orderkey, -1, 1, 1 FROM lineitem)
SELECT workspace_id, id, row_number() OVER (PARTITION BY workspace_id ORDER BY late, position, id) AS position FROM r""",
    "orphaned_rows": "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)",
    "chat_sessions": "SELECT event_id AS request_id, CASE WHEN own THEN 's' || (event_id % 4000) ELSE 's-' || event_id END AS session_id, NOT own AS created FROM (SELECT event_id, event_id % 4000 IN (SELECT c_custkey FROM customer) AND event_id % 4000 % 3 = event_id % 5 AS own FROM events)",
    "generation_plan": """WITH f AS (SELECT doc_id, n_chars, unnest(['summary', 'tags', 'entities', 'relationships']) AS feature FROM documents)
SELECT doc_id AS id, feature, CASE WHEN doc_id % 7 = 0 THEN 'document:' || doc_id ELSE 'version:' || (doc_id * 10) END AS target FROM f
WHERE CASE WHEN doc_id % 7 = 0 THEN feature <> 'entities' ELSE doc_id % 4 <> 0 AND n_chars >= 300 END AND (doc_id, feature) NOT IN (SELECT doc_id, CASE WHEN quality = 1 THEN 'summary' ELSE 'tags' END FROM labels)""",
    "part_rollup": """SELECT p_partkey % 20 AS parent_id, count(*) AS n, md5(string_agg(CASE WHEN p_partkey % 2 = 0 THEN 'Chapter ' || p_partkey ELSE p_name END || ': ' || p_type, chr(10) ORDER BY p_partkey % 3 = 0, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 11 END, p_partkey)) AS summaries_md5
FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1""",
    "mapped_summaries": """WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, x FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(x, ' ') <> ''),
r AS (SELECT doc_id, n, 0::BIGINT AS w, length(x) AS size, x AS body FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, CASE WHEN r.size + length(p.x) > 3000 THEN r.w + 1 ELSE r.w END, CASE WHEN r.size + length(p.x) > 3000 THEN length(p.x) ELSE r.size + length(p.x) END,
    CASE WHEN r.size + length(p.x) > 3000 THEN left(p.x, 40) ELSE left(r.body || chr(10) || chr(10) || p.x, 40) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.n = r.n + 1),
s AS (SELECT doc_id, w, arg_max(left(body, 40), n) AS s FROM r GROUP BY 1, 2)
SELECT doc_id AS id, count(*) AS windows, CASE WHEN count(*) = 1 THEN min(s) ELSE left(string_agg(s, chr(10) || chr(10) ORDER BY w), 100) END AS summary FROM s GROUP BY 1""",
    "container_manifests": "SELECT p_partkey % 20 AS parent_id, count(*) AS parts, sha256(string_agg(p_partkey || chr(9) || p_name || chr(9) || sha256(p_type), chr(10) ORDER BY p_partkey)) AS manifest FROM part GROUP BY 1",
    "nested_manifests": f"""WITH t AS ({TREE}), h0 AS (SELECT k, md5(p_name) AS h FROM t),
m1 AS (SELECT parent, sha256(string_agg(t.k || chr(9) || p_name || chr(9) || h, chr(10) ORDER BY t.k)) AS h FROM t JOIN h0 ON h0.k = t.k WHERE parent IS NOT NULL GROUP BY 1), h1 AS (SELECT h0.k, coalesce(m1.h, h0.h) AS h FROM h0 LEFT JOIN m1 ON m1.parent = h0.k),
m2 AS (SELECT parent, sha256(string_agg(t.k || chr(9) || p_name || chr(9) || h, chr(10) ORDER BY t.k)) AS h FROM t JOIN h1 ON h1.k = t.k WHERE parent IS NOT NULL GROUP BY 1)
SELECT h1.k AS document_id, coalesce(m2.h, h1.h) AS content_hash FROM h1 LEFT JOIN m2 ON m2.parent = h1.k""",
    "family_tree": f"""WITH RECURSIVE t AS ({TREE}), r AS (SELECT k AS root_id, k AS document_id, 0::BIGINT AS depth, '' AS path FROM t WHERE parent IS NULL
  UNION ALL SELECT root_id, t.k, depth + 1, path || CASE WHEN depth > 0 THEN '/' ELSE '' END || coalesce(ord, 2147483648) FROM r JOIN t ON t.parent = r.document_id)
SELECT root_id, document_id, depth, path FROM r""",
    "folded_hits": f"SELECT l_orderkey AS query_id, coalesce(parent, k) AS container, min(l_linenumber) AS rank, count(*) AS n FROM lineitem JOIN ({TREE}) ON k = l_partkey GROUP BY 1, 2",
    "reextraction": """SELECT outcome, count(*) AS n FROM (SELECT CASE doc_id % 10 WHEN 9 THEN 'untouched' WHEN 8 THEN 'untouched' WHEN 0 THEN 'failed' WHEN 1 THEN CASE WHEN upper(text) = text THEN 'same' ELSE 'changed' END ELSE 'same' END AS outcome FROM documents
UNION ALL SELECT 'new' FROM documents WHERE doc_id % 10 = 8) GROUP BY 1""",
    "reindex_preview": f"""WITH c AS (SELECT doc_id, lower(text) = text AS plain, CASE WHEN n <= 350 THEN least(n, 1) ELSE CAST(ceil((n - 350) / 275.0) AS BIGINT) + 1 END AS chunks FROM (SELECT doc_id, text, len({SPLIT}) AS n FROM documents)),
a AS (SELECT CASE WHEN doc_id % 6 < 2 THEN 'write' WHEN doc_id % 6 = 2 AND NOT plain THEN 'rewrite' ELSE 'keep' END AS action, chunks FROM c UNION ALL SELECT 'drop', 2 FROM c WHERE doc_id % 6 = 1)
SELECT action, count(*) AS sources, CAST(sum(chunks) AS BIGINT) AS chunks FROM a GROUP BY 1""",
    "ledger_repairs": """WITH l AS (SELECT doc_id AS id, doc_id % 5 AS said FROM documents), s AS (SELECT CASE WHEN doc_id % 4 = 1 THEN doc_id + 5000 ELSE doc_id END AS id, doc_id % 5 AS there FROM documents WHERE doc_id % 4 <> 0),
k AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 UNION SELECT doc_id + 5000 FROM documents WHERE doc_id % 3 <> 0), j AS (SELECT coalesce(l.id, s.id) AS id, said, there FROM l FULL JOIN s ON l.id = s.id)
SELECT id, action FROM (SELECT id, CASE WHEN id NOT IN (SELECT id FROM k) THEN 'purge' WHEN said IS NULL THEN 'add' WHEN said <> coalesce(there, 0) THEN 'recount' END AS action FROM j) WHERE action IS NOT NULL""",
    "cache_report": f"""SELECT tree, state, state = 'orphan' AND tree <> 'archive' AS prunable, count(*) AS n, CAST(sum(CASE WHEN state = 'orphan' THEN n_chars ELSE 0 END) AS BIGINT) AS bytes FROM (
SELECT tree, n_chars, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 = 0 THEN 'orphan' WHEN doc_id % 5 = 0 AND doc_id % 4 <> 0 THEN 'missing' END AS state FROM ({FILES})) WHERE state IS NOT NULL GROUP BY 1, 2""",
    "disk_usage": f"SELECT tree, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM ({FILES}) WHERE doc_id % 5 <> 0 GROUP BY 1",
    "opened_documents": """SELECT page_id AS request_id, CASE WHEN page_id % 4 < 2 AND page_id % 3 <> 0 THEN page_id END AS id, CASE WHEN page_id % 4 = 0 AND page_id % 3 <> 0 THEN 'id' WHEN page_id % 4 = 1 AND page_id % 3 <> 0 THEN 'url' WHEN page_id % 4 = 3 THEN 'none' ELSE 'stub' END AS how FROM pages""",
    "moved_tables": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 9 ELSE quality END AS quality, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'moved' END AS note, 'new' AS era FROM labels",
    "inserted_rows": """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1""",
    "current_editions": "SELECT o_orderkey AS version_id, 1 AS is_current FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "provider_states": """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 2 THEN 'rate_limited' WHEN event_id % 7 = 1 THEN 'auth_error' WHEN event_id % 5 = 0 THEN 'not_found' WHEN event_id % 5 = 1 THEN 'offline' WHEN event_id % 7 = 2 OR event_id % 5 = 3 THEN 'server_error' ELSE 'error' END AS state FROM events""",
    "batch_outputs": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL AND d.doc_id % 9 <> 0 THEN d.doc_id || ':' || length(text) END AS output, CASE WHEN l.doc_id IS NULL AND d.doc_id % 9 = 0 THEN 'bad ' || d.doc_id END AS error FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "answer_citations": "SELECT conv_id * 1000 + turn AS answer_id, 2 AS n_citations, CASE WHEN conv_id % 2 = 0 AND conv_id IN (SELECT doc_id FROM documents) THEN 1 ELSE 2 END AS unresolved FROM conversations WHERE role = 'assistant'",
    "stream_events": """WITH p AS (SELECT conv_id, turn, conv_id % 3 = 0 AND turn = 3 AS bad FROM conversations), s AS (SELECT conv_id, max(turn) AS last, bool_or(bad) AS lost FROM p GROUP BY 1),
e AS (SELECT conv_id AS session, -1 AS position, 'meta' AS event, conv_id::VARCHAR AS data FROM s UNION ALL SELECT p.conv_id, turn, CASE WHEN bad THEN 'error' ELSE 'token' END, CASE WHEN bad THEN 'lost' ELSE 'part ' || turn END FROM p JOIN s USING (conv_id) WHERE turn % 4 <> 2 AND (NOT lost OR turn <= 3)
  UNION ALL SELECT conv_id, last + 1, 'done', '' FROM s WHERE NOT lost)
SELECT session, position, event, md5('event: ' || event || chr(10) || 'data: ' || data || chr(10) || chr(10)) AS wire_md5 FROM e""",
    "context_manifests": """WITH f AS (SELECT conv_id AS id, string_agg('- [[attachment:' || turn || '|' || CASE WHEN turn % 2 = 0 THEN 'b' ELSE 'A' END || turn || '.pdf]]; type=pdf; source_url=u; extraction_status=unknown; text_available=' || CASE WHEN turn > 0 THEN 'yes' ELSE 'no' END || '; indexed=' || CASE WHEN turn > 1 THEN 'yes' ELSE 'no' END, chr(10) ORDER BY CASE WHEN turn % 2 = 0 THEN 'b' ELSE 'a' END || turn) AS lines FROM conversations GROUP BY 1)
SELECT doc_id AS id, md5('Circular: [[circular:' || doc_id || '|C' || doc_id || ']]' || chr(10) || 'Title: T' || chr(10) || 'Department: ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Unknown' END || chr(10) || 'Date: ' || CASE WHEN doc_id % 3 = 0 THEN '2024-01-01' ELSE 'Unknown' END || chr(10) || 'Source URL: Unavailable' || chr(10) || 'Attachments:' || chr(10) || coalesce(lines, '- None')) AS manifest_md5
FROM documents LEFT JOIN f ON f.id = doc_id""",
    "direct_texts": """WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(1, (length(text) + 3) // 4) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, 0::BIGINT AS n, 300::BIGINT AS room, NULL::BIGINT AS turn, NULL::BIGINT AS tokens FROM conversations GROUP BY 1
  UNION ALL SELECT t.conv_id, t.n, CASE WHEN t.tokens <= r.room THEN r.room - t.tokens ELSE r.room END, CASE WHEN t.tokens <= r.room THEN t.turn END, t.tokens FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
SELECT conv_id AS session, turn AS position, tokens FROM r WHERE turn IS NOT NULL""",
    "budgeted_passages": """WITH t AS (SELECT conv_id, turn, length(text) AS chars, greatest(1, (length(text) + 3) // 4) AS tokens FROM conversations), b AS (SELECT *, 120 - coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t)
SELECT conv_id AS query_id, turn + 1 AS rank, CAST(CASE WHEN tokens > room THEN least(chars, room * 4) ELSE chars END AS BIGINT) AS chars FROM b WHERE room > 0""",
    "chat_context": """WITH m AS (SELECT conv_id, string_agg('m' || turn, chr(10) || chr(10) ORDER BY turn) AS m, max(CASE WHEN turn = 1 THEN text END) AS d, max(CASE WHEN turn = 2 THEN text END) AS p FROM conversations GROUP BY 1)
SELECT conv_id AS session, md5(concat_ws(chr(10) || chr(10), 'Selected circular and attachment manifest:', m, CASE WHEN d IS NOT NULL THEN 'Small documents included in full:' || chr(10) || chr(10) || 'Source: [[1]]' || chr(10) || 'Full extracted text:' || chr(10) || d END,
CASE WHEN p IS NOT NULL THEN 'Automatically retrieved passages for this question:' || chr(10) || chr(10) || 'Source: [[2]]' || chr(10) || 'Passage:' || chr(10) || p END)) AS context_md5 FROM m""",
    "document_picks": f"""WITH h AS (SELECT conv_id, turn, len(list_intersect(list_distinct({_tok("text")}), ['of', 'und', 'que', 'dans', 'der', 'en', 'la', 'est'])) AS hits FROM conversations)
SELECT conv_id AS owner, turn::VARCHAR AS source_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, turn) AS r FROM h) WHERE r = 1""",
    "scoped_search": f"""WITH t AS (SELECT doc_id, {_tok("text")} AS t FROM documents WHERE lang = 'de'), p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS dl FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY 1, 2), tot AS (SELECT count(*) AS n, avg(len(t)) AS m FROM t),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, tot GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tok("text")}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))), 6) AS score FROM q JOIN idf USING (term) JOIN p USING (term), tot GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id AS query_id, doc_id AS id, round(1.0::DOUBLE / (60 + rank), 8) AS score, 1 AS arms, rank FROM r WHERE rank <= 5""",
    "term_sets": """WITH r AS (SELECT r_regionkey AS query_id, 0 AS part, 0 AS position, r_name AS term FROM region UNION ALL SELECT n_regionkey, 1, n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT CAST(c_custkey % 5 AS INTEGER), 2, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'nation_2' ELSE 'Term ' || c_custkey END FROM customer),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY part, position) AS r FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY position) AS n FROM o WHERE r = 1)
SELECT query_id, term, ['verbatim', 'caller', 'generated'][part + 1] AS origin FROM n WHERE part < 2 OR n <= 48""",
    "answer_fields": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'd' END AS terms FROM events",
    "inventory_results": """WITH c AS (SELECT doc_id, source, unnest([0, 1, 2]) AS n, unnest([doc_id, doc_id + 1000000, doc_id + 100]) AS chunk FROM documents),
e AS (SELECT c.doc_id, source, n, v.vec_id FROM c JOIN embeddings v ON v.vec_id = chunk)
SELECT doc_id AS key, source AS title, n, CASE WHEN vec_id % 3 = 1 THEN 'span ' ELSE 'passage ' END || vec_id AS text, vec_id % 3 = 1 AS verified, CASE WHEN vec_id % 2 = 0 THEN 'p. ' || (vec_id % 9) WHEN vec_id % 4 = 1 THEN 'offset ' || vec_id ELSE 'chunk ' || vec_id END AS locator FROM e
UNION ALL SELECT doc_id, source, NULL, NULL, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e)""",
    "index_state": """WITH s AS (SELECT doc_id AS id, doc_id % 4 AS expected, doc_id % 11 = 0 AS out_, length(text) < 300 AS short FROM documents), l AS (SELECT vec_id AS id, vec_id % 3 AS stored FROM embeddings)
SELECT CASE WHEN out_ THEN 'excluded: external' WHEN short THEN 'unsearchable: short' WHEN expected IS NULL THEN 'orphan' WHEN expected = 0 THEN 'empty' WHEN stored IS NULL THEN 'missing' WHEN expected = stored THEN 'indexed' ELSE 'stale' END AS status, count(*) AS sources, CAST(coalesce(sum(stored), 0) AS BIGINT) AS chunks
FROM s FULL JOIN l ON s.id = l.id GROUP BY 1""",
    "fingerprint_check": "SELECT DISTINCT 'model-' || (label % 3) AS fingerprint, len(embedding) + label % 2 AS width FROM embeddings WHERE len(embedding) + label % 2 <> 64",
    "clean_entities": """SELECT l_orderkey AS id, l_linenumber, ['ratio', 'deadline', 'requirement', 'gossip', 'fee'][l_orderkey % 5 + 1] AS entity_type, CASE WHEN l_orderkey % 5 = 1 THEN 2024.0 WHEN l_orderkey % 3 <> 0 THEN (1000 + l_orderkey % 1000 + 0.5)::DOUBLE END AS value_numeric,
CASE WHEN l_orderkey % 5 = 1 THEN '2024-05-' || lpad((l_orderkey % 28 + 1)::VARCHAR, 2, '0') END AS day FROM lineitem WHERE l_orderkey % 5 <> 3 AND l_orderkey % 7 <> 0 AND (l_orderkey % 5 IN (1, 2) OR l_orderkey % 3 <> 0)""",
    "valid_items": """WITH c AS (SELECT DISTINCT o_orderkey, unnest([o_orderkey % 50, o_orderkey % 7]) AS b FROM orders)
SELECT o_orderkey AS item_id, string_agg(b::VARCHAR, ',' ORDER BY b::VARCHAR) AS cited, min(b % 6) AS page_start, max(b % 6) AS page_end FROM c WHERE b IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1""",
    "valid_relations": """WITH e AS (SELECT doc_id AS s, doc_id % 97 AS t, CASE doc_id % 5 WHEN 0 THEN 'amends' WHEN 1 THEN 'supersedes' WHEN 2 THEN 'clarifies' WHEN 3 THEN 'adds_to' ELSE CASE WHEN doc_id % 3 = 0 THEN 'cancels' ELSE 'references' END END AS kind, CASE WHEN doc_id % 2 = 0 THEN greatest((doc_id % 10) / 10.0, 0.5) ELSE 0.5 END AS c FROM documents WHERE doc_id > 96)
SELECT s AS source_id, t AS target_id, kind, c::DOUBLE AS confidence FROM e WHERE t % 3 <> 0 AND t IN (SELECT doc_id FROM documents)""",
    "harvested_edges": """WITH e AS (SELECT doc_id AS s, doc_id % 97 AS t, CASE doc_id % 5 WHEN 0 THEN 'amends' WHEN 1 THEN 'supersedes' WHEN 2 THEN 'clarifies' WHEN 3 THEN 'adds_to' ELSE CASE WHEN doc_id % 3 = 0 THEN 'cancels' ELSE 'references' END END AS kind FROM documents WHERE doc_id > 96)
SELECT s AS source_id, t AS target_id, kind, 0.9::DOUBLE AS confidence FROM e UNION ALL SELECT doc_id, doc_id % 90, 'clarifies', 0.4 FROM documents WHERE doc_id >= 90 AND NOT (doc_id > 96 AND doc_id % 97 = doc_id % 90)""",
    "attachment_names": "SELECT page_id, 'File' || page_id || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xlsx' ELSE '' END AS filename, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' ELSE '' END AS file_type FROM pages",
    "stale_chains": """WITH m AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS now FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_orderkey % 10 = 0 OR CASE l_orderkey % 3 WHEN 0 THEN list_reverse(now) <> now WHEN 1 THEN false ELSE true END AS stale FROM m""",
    "benchmark_questions": "SELECT item_id % 4 AS page, 'Q' || item_id AS key, trim(replace(substr(text, 1, 30), chr(10), ' ')) AS question FROM benchmark",
    "index_audit": "SELECT user_id, count(*) AS n, (SELECT max(event_id) FROM events) - max(event_id) AS behind FROM events GROUP BY 1",
    "latest_of_each": "SELECT e.user_id, count(*) AS interrupted FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'click' GROUP BY 1) l USING (user_id) WHERE event_type <> 'view' AND (last IS NULL OR event_id > last) GROUP BY 1",
}
