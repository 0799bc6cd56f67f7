"""Queries over state that is carried on: timers, closures under changing edges, digest trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import supersession
from lexweave.operators.batches import resumed
from lexweave.operators.digest_tree import DigestTree
from lexweave.operators.kept_chains import KeptChains
from lexweave.plans import deep
from lexweave.session import shared_folder, table
from lexweave.sources.snapshots import SnapshotTable
from lexweave.streaming import jobs, timed


def currency_by_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customers' documents, each in force some days after it is listed: the one in force at the end."""
    ahead = F.make_dt_interval(days=(F.col("o_orderkey") % 90).cast("int"))
    orders = jobs.stream_of(spark, sf_dir, "orders")
    versions = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderdate") + ahead).alias("effective_from"), F.col("o_orderdate").alias("ts"))
    with timed.timed(spark):
        flips = jobs.drain(timed.currency_flips(versions))
    return flips.groupBy("document_id").agg(F.max_by("version_id", F.struct("effective_from", -F.col("version_id"))).alias("version_id"))


def traces_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as a trace: a purchase finishes it, six hours without a sign interrupt it."""
    events = jobs.stream_of(spark, sf_dir, "events")
    traces = events.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("trace_id"), (F.col("event_type") == "purchase").alias("ends"), "ts")
    with timed.timed(spark):
        return jobs.drain(timed.trace_ends(traces, 6 * 3600)).select("trace_id", "state")


def _rewritten(spark: SparkSession, sf_dir: str) -> tuple[KeptChains, DataFrame]:
    """Chains over the documents' edges, of which every fifth document had another first; the stale ones after the rewrite."""
    edges = deep.edges(spark, sf_dir)
    wrong = edges.withColumn("target_id", F.when(F.col("source_id") % 5 == 0, (F.col("source_id") / 3).cast("long")).otherwise(F.col("target_id")))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    kept = KeptChains(spark, shared_folder(spark, "chains"))
    kept.rewrite(wrong, sources)
    return kept, kept.rewrite(edges.where("source_id % 5 = 0"), sources.where("source_id % 5 = 0"))


def maintained_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir)[0].chains()


def stale_after_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir)[1]


def digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two states of the orders, by their digest trees."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    later = orders.where("o_orderkey % 501 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 307 == 3, "X").otherwise(F.col("o_orderstatus")))
    later = later.unionByName(orders.where("o_orderkey % 999 = 1").withColumn("o_orderkey", -F.col("o_orderkey")))
    trees = [DigestTree(spark, shared_folder(spark, "digests")).build(rows, "o_orderkey", ["o_orderstatus", "o_orderpriority"]) for rows in (orders, later)]
    return trees[0].diff(trees[1]).withColumnRenamed("key", "o_orderkey")


def resumed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each document; the first run is refused in its course, the second asks what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = SnapshotTable(spark, shared_folder(spark, "calls"), "doc_id")

    def call(row: dict, refusing: bool = False) -> str:
        if refusing and row["doc_id"] % 100 == 57:
            raise RuntimeError("too many requests")
        return f"{row['doc_id']}:{len(row['text'] or '')}"

    resumed(docs, "doc_id", lambda row: call(row, True), store)
    resumed(docs, "doc_id", call, store)
    return store.read()


def _titled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents titled by their first lines, their edges, lists and flags; every third says its last line, or a word, is its subject."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    nodes = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("day"), F.element_at("ls", 1).alias("title"))
    first = X.tokens(F.element_at("ls", 1))
    flags = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, F.element_at("ls", -1)).otherwise(F.get(first, F.size(first) - 1)).alias("subject"))
    listed = docs.where("doc_id % 10 IN (3, 4)").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") / F.when(F.col("doc_id") % 10 == 3, 7).otherwise(2)).cast("long").alias("target_id"), F.when(F.col("doc_id") % 20 < 10, "cancels").alias("kind"))
    explicit = deep.edges(spark, sf_dir).withColumn("confidence", F.lit(1.0))
    return nodes, explicit, listed, flags


def superseding_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges that the rules give, also of subjects that ``supersession_review`` shows to a person."""
    return supersession.all_edges(*_titled(spark, sf_dir)).select("source_id", "target_id", "kind", "rule")


def supersession_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supersession.supersessions(*_titled(spark, sf_dir))[1]


def rederived_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supersession.all_statuses(*_titled(spark, sf_dir))


QUERIES = {f.__name__: f for f in (currency_by_timer, traces_closed, maintained_chains, stale_after_rewrite, digest_diff, resumed_calls, superseding_edges, supersession_review, rederived_statuses)}

WRONG_SQL = deep.EDGE_SQL.replace("doc_id // 2 AS", "CASE WHEN doc_id % 5 = 0 THEN doc_id // 3 ELSE doc_id // 2 END AS")

STEMS = "list_distinct(list_transform({}, lambda w: CASE WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END))"
TITLE, LAST = deep.TOK.replace("lower(text)", "lower(ls[1])"), deep.TOK.replace("lower(text)", "lower(ls[-1])")
SUPERSEDED = f"""l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), d AS (SELECT doc_id, {TITLE} AS t, {LAST} AS u, ls[-1] AS body FROM l), w AS (SELECT doc_id, {STEMS.format('t')} AS own, CASE WHEN doc_id % 2 = 0 THEN {STEMS.format('u')} ELSE {STEMS.format('t[-1:]')} END AS want, body, t FROM d),
s AS (SELECT doc_id, own, CASE WHEN len(want) > 0 THEN want ELSE own END AS want FROM w WHERE doc_id % 3 = 0 AND CASE WHEN doc_id % 2 = 0 THEN trim(body) <> '' ELSE len(t) > 0 END),
m AS (SELECT s.doc_id AS source_id, w.doc_id AS target_id, len(list_intersect(w.own, list_distinct(list_concat(s.want, s.own)))) AS score FROM s JOIN w ON w.doc_id < s.doc_id WHERE len(s.want) > 0 AND list_has_all(w.own, s.want)),
n AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS matches, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS r FROM m),
x AS (SELECT source_id, target_id, kind, 'explicit' AS rule FROM ({deep.EDGE_SQL})),
y AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 10 = 3 THEN doc_id // 7 ELSE doc_id // 2 END AS target_id, CASE WHEN doc_id % 20 < 10 THEN 'cancels' ELSE 'supersedes' END AS kind, 'listed' AS rule FROM documents WHERE doc_id % 10 IN (3, 4)),
k AS (SELECT * FROM x UNION ALL SELECT * FROM y WHERE source_id <> target_id AND (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM x)),
z AS (SELECT * FROM k UNION ALL SELECT source_id, target_id, 'supersedes', 'blanket' FROM n WHERE (source_id, target_id) NOT IN (SELECT (source_id, target_id) FROM k WHERE kind = 'supersedes'))"""

ORACLE = {
    "superseding_edges": f"WITH {SUPERSEDED} SELECT * FROM z",
    "supersession_review": f"WITH {SUPERSEDED} SELECT DISTINCT source_id, 'blanket' AS rule, matches FROM n WHERE matches > 80",
    "rederived_statuses": f"""WITH {SUPERSEDED} SELECT d.doc_id AS id, CASE WHEN bool_or(kind = 'cancels') THEN 'cancelled' WHEN bool_or(kind = 'supersedes') THEN 'superseded' WHEN count(kind) > 0 THEN 'amended' ELSE 'active' END AS status
FROM documents d LEFT JOIN z ON d.doc_id = z.target_id GROUP BY 1""",
    "maintained_chains": deep.ORACLE["chain_closure"],
    "stale_after_rewrite": f"""WITH now AS (WITH RECURSIVE {deep.chain_sql(deep.EDGE_SQL)} SELECT seed, node FROM c), was AS (WITH RECURSIVE {deep.chain_sql(WRONG_SQL)} SELECT seed, node FROM c)
SELECT DISTINCT seed FROM ((FROM now EXCEPT FROM was) UNION ALL (FROM was EXCEPT FROM now))""",
    "resumed_calls": "SELECT doc_id, doc_id || ':' || length(coalesce(text, '')) AS output FROM documents WHERE doc_id IS NOT NULL",
    "digest_diff": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), l AS (SELECT k, CASE WHEN k % 307 = 3 THEN 'X' ELSE s END AS s FROM o WHERE k % 501 <> 7 UNION ALL SELECT -k, s FROM o WHERE k % 999 = 1)
SELECT coalesce(o.k, l.k) AS o_orderkey, CASE WHEN l.k IS NULL THEN 'gone' WHEN o.k IS NULL THEN 'new' ELSE 'changed' END AS status FROM o FULL JOIN l ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL OR o.s IS DISTINCT FROM l.s""",
    "currency_by_timer": """WITH v AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) AS e FROM orders WHERE o_custkey IS NOT NULL)
SELECT d AS document_id, arg_max(k, (e, -k)) AS version_id FROM v WHERE e <= (SELECT max(o_orderdate) FROM orders) GROUP BY 1""",
    "traces_closed": """SELECT * FROM (SELECT user_id || '/' || CAST(ts AS DATE) AS trace_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'finished' WHEN epoch_ms(max(ts)) + 21600000 <= (SELECT epoch_ms(max(ts)) FROM events) THEN 'interrupted' END AS state
FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1) WHERE state IS NOT NULL""",
}
