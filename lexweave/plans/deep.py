"""Queries beyond one SQL statement: closures, folds, markup, streams, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import markup
from lexweave.functions import text as X
from lexweave.operators import folds, graph
from lexweave.session import table
from lexweave.sources import sinks
from lexweave.streaming import jobs


KINDS = ("amends", "supersedes", "clarifies", "adds_to", "references", "cancels")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").where("doc_id > 0").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") / 2).cast("long").alias("target_id"), kind.alias("kind"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed"))


def chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of every document."""
    return graph.chain(edges(spark, sf_dir), _seeds(spark, sf_dir))


def chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every chain of a sensible size, oldest first; a document's day is its length."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("day"))
    return graph.chain_members(chain_closure(spark, sf_dir), nodes)


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within three edges of every document."""
    return graph.neighbourhood(edges(spark, sf_dir), _seeds(spark, sf_dir), 3)


def status_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.status_rollup(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), edges(spark, sf_dir))


def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge's key is a document's length by tens; it resolves where one other document has that key."""
    key = F.floor(F.col("n_chars") / 10).alias("reference")
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), key)
    edges = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), key, F.lit(None).cast("long").alias("target_id"))
    return graph.resolve(edges, nodes).select("source_id", "target_id")


def consolidation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change lists: a user is a chain, an id modulo 7 a requirement."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_id") % 3 == 0, "add").when(F.col("event_id") % 11 == 0, "remove").otherwise("modify")
    changes = e.select(F.col("user_id").alias("chain"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("source"), action.alias("action"), (F.col("event_id") % 7).cast("string").alias("req_id"), F.col("event_type").alias("requirement"))
    return folds.consolidate(changes)


def token_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", X.token_estimate(F.col("text")).alias("tokens"))
    return folds.greedy_budget(rows, "source", "doc_id", "tokens", 4000)


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", X.token_estimate(F.col("text")).alias("tokens"))
    return folds.prefix_budget(rows, "source", "doc_id", "tokens", 4000)


def checklist_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of equal canonical words stand once, with how often and in how many roles."""
    key = X.canonical_words(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy(F.md5(key).alias("key_md5")).agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.size(F.collect_set("role")).cast("long").alias("roles"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text("html").alias("text")).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.html_links("html", "url")).alias("position", "link")).select("page_id", "position", "link.url", "link.label")


def transcript_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.transcript(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("markdown").alias("markdown_md5"))


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.get(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "")]), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", sinks.cell(F.col("c_acctbal").cast("decimal(12,2)")).alias("balance"), sinks.cell(F.concat(sign, "c_name")).alias("name"))


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.drain(jobs.window_counts(jobs.stream_of(spark, sf_dir, "events")), "complete")
    return found.select(F.col("start").cast("date").cast("string").alias("day"), F.hour("start").cast("long").alias("hour"), "event_type", "n")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = jobs.stream_of(spark, sf_dir, "events")
    return jobs.drain(jobs.deduplicated(events, ["event_id"], "40 days").select("event_id", "user_id"))


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.after(jobs.stream_of(spark, sf_dir, "events"), 9000).select("event_id", "event_type"))


def stream_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = jobs.stream_of(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("slot"), "doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return jobs.incremental(docs, "slot", "doc_id")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.drain(jobs.sessions(jobs.stream_of(spark, sf_dir, "events"), late="0 minutes"), "complete")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


EDGE_SQL = "SELECT doc_id AS source_id, doc_id // 2 AS target_id, ['amends', 'supersedes', 'clarifies', 'adds_to', 'references', 'cancels'][doc_id % 6 + 1] AS kind FROM documents WHERE doc_id > 0"


def chain_sql(edges: str) -> str:
    """What a member amends comes first; only then what amends any of these."""
    return f"""e AS (SELECT * FROM ({edges}) WHERE kind IN ('amends', 'adds_to')), up AS (SELECT doc_id AS seed, doc_id AS node FROM documents UNION SELECT up.seed, e.target_id FROM up JOIN e ON up.node = e.source_id),
c AS (SELECT seed, node FROM up UNION SELECT c.seed, e.source_id FROM c JOIN e ON c.node = e.target_id)"""


CHAIN = chain_sql(EDGE_SQL)
TOK = r"list_filter(regexp_extract_all(regexp_replace(lower(text), '\b([a-z])\.([a-z]|\s|$)', '\1\2', 'g'), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "], w))"

ORACLE = {
    "chain_closure": f"WITH RECURSIVE {CHAIN} SELECT seed, node FROM c",
    "chain_order": f"""WITH RECURSIVE {CHAIN}, m AS (SELECT seed, node, CASE WHEN node % 7 <> 0 THEN n_chars END AS day FROM c JOIN documents ON doc_id = node),
k AS (SELECT seed, node, count(*) OVER (PARTITION BY seed) AS n, row_number() OVER (PARTITION BY seed ORDER BY day NULLS FIRST, node) - 1 AS position, first_value(node) OVER (PARTITION BY seed ORDER BY day NULLS FIRST, node) AS base FROM m)
SELECT seed, node, position, base FROM k WHERE n BETWEEN 2 AND 50""",
    "bfs_levels": f"""WITH RECURSIVE e AS ({EDGE_SQL}), g AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
r AS (SELECT doc_id AS seed, doc_id AS node, 0 AS level FROM documents UNION SELECT r.seed, g.b, r.level + 1 FROM r JOIN g ON r.node = g.a WHERE r.level < 3)
SELECT seed, node, min(level) AS level FROM r GROUP BY 1, 2""",
    "status_priority": f"""SELECT d.doc_id AS id, CASE WHEN bool_or(kind = 'cancels') THEN 'cancelled' WHEN bool_or(kind = 'supersedes') THEN 'superseded' WHEN count(kind) > 0 THEN 'amended' ELSE 'active' END AS status
FROM documents d LEFT JOIN ({EDGE_SQL}) e ON d.doc_id = e.target_id GROUP BY 1""",
    "reference_resolution": """SELECT d.doc_id AS source_id, CASE WHEN count(n.doc_id) = 1 THEN min(n.doc_id) END AS target_id FROM documents d LEFT JOIN documents n ON n.n_chars // 10 = d.n_chars // 10 AND n.doc_id <> d.doc_id GROUP BY 1""",
    "budget_prefix": "SELECT source, doc_id, tokens FROM (SELECT source, doc_id, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS taken FROM (SELECT source, doc_id, greatest(1, (length(text) + 3) // 4) AS tokens FROM documents)) WHERE taken <= 4000",
    "token_budget_pack": """WITH RECURSIVE t AS (SELECT source, doc_id, greatest(1, (length(text) + 3) // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source, 0::BIGINT AS n, 4000::BIGINT AS room, NULL::BIGINT AS doc_id, NULL::BIGINT AS tokens FROM documents GROUP BY source
  UNION ALL SELECT t.source, t.n, CASE WHEN t.tokens <= r.room THEN r.room - t.tokens ELSE r.room END, CASE WHEN t.tokens <= r.room THEN t.doc_id END, t.tokens FROM r JOIN t ON t.source = r.source AND t.n = r.n + 1)
SELECT source, doc_id, tokens FROM r WHERE doc_id IS NOT NULL""",
    "consolidation_fold": """WITH c AS (SELECT user_id AS chain, event_id AS p, CASE WHEN event_id % 3 = 0 THEN 'add' WHEN event_id % 11 = 0 THEN 'remove' ELSE 'modify' END AS a, (event_id % 7)::VARCHAR AS r, event_type AS t FROM events),
b AS (SELECT chain, r, min(p) AS p0 FROM c WHERE a = 'add' AND t <> '' GROUP BY 1, 2), e AS (SELECT c.chain, c.r, min(p) AS p1 FROM c JOIN b USING (chain, r) WHERE a = 'remove' AND p > p0 GROUP BY 1, 2),
l AS (SELECT c.*, p0, p1 FROM c JOIN b USING (chain, r) LEFT JOIN e USING (chain, r) WHERE p >= p0 AND p <= coalesce(p1, p))
SELECT chain, r AS req_id, arg_max(t, p) FILTER (WHERE p = p0 OR a = 'modify') AS requirement, CASE WHEN any_value(p1) IS NOT NULL THEN 'removed' WHEN any_value(p0) <> 0 THEN 'added' WHEN count(*) FILTER (WHERE a = 'modify') > 0 THEN 'modified' ELSE 'original' END AS status,
any_value(p0)::VARCHAR AS origin, 1 + count(*) FILTER (WHERE a = 'modify') + CASE WHEN any_value(p1) IS NULL THEN 0 ELSE 1 END AS history FROM l GROUP BY 1, 2""",
    "checklist_dedupe": "SELECT md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS key_md5, count(*) AS n, min(turn) AS first_turn, count(DISTINCT role) AS roles FROM conversations GROUP BY 1",
    "transcript_export": "SELECT conv_id, md5(string_agg('**' || upper(role[1]) || lower(role[2:]) || '**' || chr(10) || chr(10) || trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY 1",
    "csv_cells": "SELECT c_custkey, CASE WHEN c_acctbal::DECIMAL(12,2)::VARCHAR LIKE '-%' THEN '''' || c_acctbal::DECIMAL(12,2)::VARCHAR ELSE c_acctbal::DECIMAL(12,2)::VARCHAR END AS balance, CASE WHEN c_custkey % 5 < 4 THEN '''' || ['=', '+', '-', '@'][c_custkey % 5 + 1] ELSE '' END || c_name AS name FROM customer",
    "stream_window_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, hour(ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "stream_dedupe": "SELECT DISTINCT event_id, user_id FROM events",
    "stream_tail": "SELECT event_id, event_type FROM events WHERE event_id > 9000",
    "stream_incremental_index": f"SELECT doc_id % 300 AS slot, max(doc_id) AS doc_id, arg_max(len({TOK}), doc_id) AS n_tokens FROM documents GROUP BY 1",
    "stream_sessions": """SELECT user_id, sum(fresh) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        chain_closure, chain_order, bfs_levels, status_priority, reference_resolution, consolidation_fold, token_budget_pack, budget_prefix, checklist_dedupe, html_text, html_links,
        transcript_export, csv_cells, stream_window_counts, stream_dedupe, stream_tail, stream_incremental_index, stream_sessions,
    )
}
