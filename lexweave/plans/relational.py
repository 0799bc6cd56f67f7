"""Queries of filters, joins, aggregations, windows, sorts and pages, by the library's operators, and their SQL.

The tables stand for the corpus: orders are circulars, line items regulatory
values, parts metrics, suppliers departments, customers subjects, events trace
events, conversations chat messages. A document's edges and dates follow from
its id by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import graph
from lexweave.operators import relational as O
from lexweave.operators.corpus import reconcile
from lexweave.plans.shared import duckdb_query
from lexweave.session import table

EDGES = """(SELECT doc_id AS source_id, doc_id % 97 AS target_id,
  CASE doc_id % 5 WHEN 0 THEN 'amends' WHEN 1 THEN 'supersedes' WHEN 2 THEN 'clarifies' WHEN 3 THEN 'adds_to' ELSE CASE WHEN doc_id % 3 = 0 THEN 'cancels' ELSE 'references' END END AS kind
  FROM {documents} WHERE doc_id > 96)"""

SQL = {
    # Filters and projections
    "filter_set": """SELECT doc_id, source, lang FROM {documents}
        WHERE source IS NOT NULL AND lower(source) LIKE '%src1%' AND lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 20000""",
    "allow_sets": """SELECT o_orderkey, o_orderstatus FROM {orders}
        WHERE o_orderstatus IN ('O', 'F') AND year(o_orderdate) BETWEEN 1993 AND 1997 AND o_totalprice > 1000""",
    "cli_scope": """SELECT o_orderkey, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {orders}
        WHERE (lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%high%') AND year(o_orderdate) IN (1994, 1996)
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
    "value_range_filter": """SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}
        WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_returnflag = 'R' AND l_discount > 0.05""",
    "freshness_predicate": """SELECT item_id, CASE WHEN lower(text) LIKE '% the latest %' OR lower(text) LIKE '%current%' OR lower(text) LIKE '%newest%' THEN 1 ELSE 0 END AS wants_newest FROM {benchmark}""",
    "null_or_kind": """SELECT event_id, kind FROM (SELECT event_id, nullif(event_type, 'view') AS kind FROM {events}) WHERE kind IS NULL OR kind = 'click'""",
    "summary_projection": """SELECT doc_id, coalesce(source, 'unknown') AS department, n_chars > 1000 AS is_long,
        concat('doc-', CAST(doc_id AS STRING)) AS label FROM {documents}""",
    "entity_projection": """SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, '-') AS comparator,
        CASE WHEN l_linestatus = 'O' THEN true ELSE false END AS in_force FROM {lineitem}""",
    "column_pruning": """SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 300000""",
    "contains_any_column": """SELECT c_custkey FROM {customer} WHERE lower(c_name) LIKE '%99%' OR lower(c_mktsegment) LIKE '%build%'""",
    "browse_department_year": """SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995""",
    "browse_recent": """SELECT o_orderkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25""",
    "trace_filter": """SELECT event_id, user_id FROM {events} WHERE event_type = 'click' AND (user_id = 3 OR event_id = 3 OR user_id = 17)""",
    "session_visibility": """SELECT c.conv_id, max(c.turn) AS last_turn FROM {conversations} c
        WHERE c.conv_id NOT IN (SELECT doc_id FROM {labels} WHERE toxic = 1 AND doc_id IS NOT NULL) GROUP BY c.conv_id ORDER BY last_turn DESC, c.conv_id LIMIT 50""",
    # Joins
    "value_query_star": """SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, p.p_brand, s.s_name FROM {lineitem} l
        LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey LEFT JOIN {part} p ON l.l_partkey = p.p_partkey
        LEFT JOIN {supplier} s ON l.l_suppkey = s.s_suppkey WHERE l.l_quantity > 45""",
    "left_join_current": """SELECT d.doc_id, v.quality FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} WHERE toxic = 0 GROUP BY doc_id) v ON d.doc_id = v.doc_id""",
    "inner_join_pending": """SELECT l.l_orderkey, l.l_linenumber FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        WHERE o.o_orderpriority = '2-HIGH' AND l.l_shipdate > o.o_orderdate AND l.l_returnflag <> 'N'""",
    "parent_children_counts": """SELECT o.o_orderkey, count(l.l_linenumber) AS children, coalesce(max(l.l_linenumber), 0) AS last_child
        FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""",
    "semi_join_filter": """SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)""",
    "anti_join_new": """SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id""",
    "delist_missing": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS delisted FROM {documents} d
        LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id""",
    "not_exists_stub": """SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)""",
    "reconcile_full_outer": """SELECT coalesce(e.id, s.id) AS id, coalesce(e.expected, 0) AS expected, coalesce(s.stored, 0) AS stored,
        CASE WHEN e.id IS NULL THEN 'orphan' WHEN s.id IS NULL THEN 'missing' WHEN e.expected = s.stored THEN 'indexed' ELSE 'stale' END AS status
        FROM (SELECT doc_id AS id, CAST(ceil(n_chars / 1000.0) AS BIGINT) AS expected FROM {documents} WHERE doc_id % 7 <> 0) e
        FULL OUTER JOIN (SELECT vec_id AS id, count(*) AS stored FROM {embeddings} GROUP BY vec_id) s ON e.id = s.id""",
    "lookup_join": """SELECT s.s_suppkey, n.n_name, r.r_name FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "label_by_discriminator": """SELECT e.event_id, CASE WHEN e.event_type = 'click' THEN d.source ELSE c.c_name END AS label FROM {events} e
        LEFT JOIN {documents} d ON e.user_id = d.doc_id LEFT JOIN {customer} c ON e.user_id = c.c_custkey""",
    "edge_endpoints": f"""SELECT e.source_id, e.target_id, e.kind, a.lang AS source_lang, b.lang AS target_lang FROM {EDGES} e
        JOIN {{documents}} a ON e.source_id = a.doc_id JOIN {{documents}} b ON e.target_id = b.doc_id""",
    "self_join_label": """SELECT c.doc_id, concat(p.source, ' - ', c.source) AS label FROM {documents} c JOIN {documents} p ON c.doc_id % 13 = p.doc_id WHERE c.doc_id > 12""",
    "multi_key_join": """SELECT DISTINCT p.page_id, q.page_id AS same_id FROM {pages} p JOIN (
        SELECT page_id, lower(url) AS k FROM {pages} UNION SELECT page_id, lower(concat(url, '/')) FROM {pages}) q ON lower(p.url) = q.k""",
    "asof_latest": """SELECT l_partkey, o_orderkey FROM (SELECT l.l_partkey, o.o_orderkey,
        row_number() OVER (PARTITION BY l.l_partkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate <= TIMESTAMP '1996-06-30 00:00:00') t WHERE r = 1""",
    # Set operations
    "candidate_union": """SELECT id, min(arm_rank) AS best_rank, count(*) AS arms FROM (
        SELECT doc_id AS id, doc_id % 50 AS arm_rank FROM {documents} WHERE lang = 'en' UNION ALL SELECT vec_id, label FROM {embeddings}
        UNION ALL SELECT doc_id, 0 FROM {labels} WHERE quality = 1) t GROUP BY id""",
    "union_candidates_truncated": """SELECT id, lexical, semantic FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 0 ELSE 1 END AS lexical, coalesce(b.score, 0) AS semantic
        FROM (SELECT doc_id AS id FROM {documents} WHERE lang = 'de') a FULL OUTER JOIN (SELECT vec_id AS id, label AS score FROM {embeddings}) b ON a.id = b.id) t
        ORDER BY lexical DESC, semantic DESC, id LIMIT 100""",
    "set_difference": """SELECT doc_id FROM {documents} EXCEPT SELECT vec_id FROM {embeddings}""",
    "intersection_counts": """SELECT count(*) AS n FROM (SELECT doc_id FROM {documents} INTERSECT SELECT vec_id FROM {embeddings}) t""",
    "multi_source_priority": """SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY priority) AS r FROM (
        SELECT user_id AS k, round(sum(value), 3) AS v, 2 AS priority FROM {events} WHERE event_type = 'view' GROUP BY user_id UNION ALL
        SELECT user_id, round(max(value), 3), 1 FROM {events} WHERE event_type = 'click' GROUP BY user_id) u) t WHERE r = 1""",
    "round_robin": """SELECT id, arm, turn FROM (SELECT doc_id AS id, lang AS arm, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM {documents}) t ORDER BY turn, arm LIMIT 40""",
    # Aggregations
    "coverage_conditional_counts": """SELECT count(*) AS total, count(DISTINCT source) AS departments, count(CASE WHEN lang = 'en' THEN 1 END) AS english,
        count(CASE WHEN n_chars > 5000 THEN 1 END) AS long_ones, min(n_chars) AS shortest, max(n_chars) AS longest FROM {documents}""",
    "dept_facet": """SELECT source, count(*) AS n FROM {documents} GROUP BY source ORDER BY source""",
    "year_facet": """SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} WHERE o_orderpriority = '3-MEDIUM' AND o_orderdate IS NOT NULL GROUP BY year(o_orderdate) ORDER BY y DESC""",
    "status_facet": """SELECT coalesce(o_orderstatus, 'unknown') AS status, count(*) AS n FROM {orders} GROUP BY coalesce(o_orderstatus, 'unknown')""",
    "type_facet": """SELECT p_type, count(*) AS n FROM {part} WHERE p_type <> '' GROUP BY p_type ORDER BY n DESC, p_type""",
    "index_overview": """SELECT event_type, count(*) AS n, coalesce(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END), 0) AS large, max(event_id) AS newest FROM {events} GROUP BY event_type""",
    "run_history": """SELECT event_id, user_id, coalesce(event_type, 'circulars') AS kind FROM {events} ORDER BY event_id DESC LIMIT 20""",
    "distinct_departments": """SELECT count(DISTINCT o_orderpriority) AS n FROM {orders}""",
    "min_max_latest": """SELECT o_orderpriority, CAST(CAST(min(o_orderdate) AS DATE) AS STRING) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS STRING) AS last_day, max(o_orderkey) AS last_key FROM {orders} GROUP BY o_orderpriority""",
    "trace_rollup": """SELECT user_id AS trace_id, count(*) AS events, coalesce(sum(length(props)), 0) AS payload_bytes, max(event_id) AS last_event, count(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id""",
    "ledger_status": """SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars % 3 = 0 THEN 'indexed' ELSE 'stale' END AS status FROM {documents}) t GROUP BY status""",
    "status_rollup": f"""SELECT d.doc_id, CASE max(CASE WHEN e.target_id IS NULL THEN 0 WHEN e.kind = 'cancels' THEN 3 WHEN e.kind = 'supersedes' THEN 2 ELSE 1 END)
        WHEN 3 THEN 'cancelled' WHEN 2 THEN 'superseded' WHEN 1 THEN 'amended' ELSE 'active' END AS status
        FROM {{documents}} d LEFT JOIN {EDGES} e ON d.doc_id = e.target_id GROUP BY d.doc_id""",
    "in_out_degree": f"""SELECT d.doc_id, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM {{documents}} d
        LEFT JOIN (SELECT source_id, count(*) AS n FROM {EDGES} e GROUP BY source_id) o ON d.doc_id = o.source_id
        LEFT JOIN (SELECT target_id, count(*) AS n FROM {EDGES} e GROUP BY target_id) i ON d.doc_id = i.target_id""",
    "relation_grouping": f"""SELECT target_id, kind, count(*) AS n, min(source_id) AS first_source FROM {EDGES} e GROUP BY target_id, kind""",
    "latest_per_metric_subject": """SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT l_partkey, l_suppkey, l_orderkey,
        row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC) AS r FROM {lineitem}) t WHERE r = 1""",
    "value_query_current": """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT l.l_partkey, l.l_orderkey, l.l_linenumber,
        row_number() OVER (PARTITION BY l.l_partkey ORDER BY l.l_shipdate DESC NULLS LAST, o.o_orderdate DESC NULLS LAST, l.l_orderkey DESC, l.l_linenumber DESC) AS r
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE NOT (o.o_orderstatus IN ('F', 'P'))) t WHERE r = 1""",
    "strongest_link": f"""SELECT target_id, source_id, kind FROM (SELECT target_id, source_id, kind, row_number() OVER (PARTITION BY target_id
        ORDER BY CASE kind WHEN 'supersedes' THEN 4 WHEN 'amends' THEN 3 WHEN 'adds_to' THEN 2 WHEN 'clarifies' THEN 1 ELSE 0 END DESC, source_id) AS r FROM {EDGES} e) t WHERE r = 1""",
    "attachment_dedupe": """SELECT source, n_chars, doc_id FROM (SELECT source, n_chars, doc_id, row_number() OVER (PARTITION BY source, n_chars
        ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS r FROM {documents}) t WHERE r = 1""",
    "rater_scores": """SELECT source, round(avg(capped), 4) AS score, count(CASE WHEN toxic = 1 THEN 1 END) AS gated FROM (
        SELECT d.source, l.toxic, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 25 ELSE 60 + d.n_chars % 40 END AS capped
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id) t GROUP BY source""",
    "rater_agreement": """SELECT count(*) AS cells, count(CASE WHEN quality = 1 - toxic THEN 1 END) AS agreed FROM {labels}""",
    "paired_wins": """SELECT a.label AS a, b.label AS b, count(CASE WHEN a.vec_id > b.vec_id THEN 1 END) AS wins, count(*) AS pairs
        FROM {embeddings} a JOIN {embeddings} b ON a.vec_id % 25 = b.vec_id % 25 AND a.label < b.label GROUP BY a.label, b.label""",
    "inventory_coverage": """SELECT count(*) AS in_scope, count(v.vec_id) AS indexed, count(*) - count(v.vec_id) AS gap, count(CASE WHEN l.quality = 1 THEN 1 END) AS included
        FROM {documents} d LEFT JOIN {embeddings} v ON d.doc_id = v.vec_id LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # Windows
    "first_appearance_rank": """SELECT owner, min_pos, dense_rank() OVER (ORDER BY min_pos) AS rank FROM (SELECT label AS owner, min(vec_id) AS min_pos FROM {embeddings} GROUP BY label) t""",
    "evidence_top3": """SELECT owner, vec_id, r FROM (SELECT label AS owner, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM {embeddings}) t WHERE r <= 3""",
    "rolling_sum": """SELECT user_id, event_id, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS hits FROM {events}""",
    "carry_forward": """SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM {events}""",
    "occurrence_number": """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS occurrence FROM {conversations}""",
    "boundary_groups": """SELECT conv_id, turn, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM (
        SELECT conv_id, turn, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS changed FROM {conversations}) t""",
    "sequence_per_partition": """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM {events}""",
    "history_truncate": """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}) t WHERE r < 4""",
    "version_currency": """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey
        ORDER BY CASE WHEN l_shipdate <= TIMESTAMP '1996-01-01 00:00:00' THEN 0 ELSE 1 END, l_shipdate DESC, l_orderkey, l_linenumber) AS r
        FROM {lineitem} WHERE l_shipdate IS NULL OR l_shipdate <= TIMESTAMP '1996-01-01 00:00:00') t WHERE r = 1""",
    # Sorts and pages
    "paging_offset": """SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""",
    "date_sort_mixed": """SELECT id FROM (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS a, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id END AS b FROM {documents}) t
        ORDER BY coalesce(a, b, 0) DESC, id LIMIT 30""",
    "ordering_nulls_last": """SELECT id, k FROM (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars END AS k FROM {documents}) t ORDER BY k DESC NULLS LAST, id LIMIT 1000""",
    "two_key_sort": """SELECT s_suppkey, s_nationkey FROM {supplier} ORDER BY s_nationkey, s_name DESC LIMIT 60""",
    "arm_top_k": """SELECT arm, id, r FROM (SELECT lang AS arm, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM {documents}) t WHERE r <= 10""",
    "page_clamp": """SELECT n AS asked, greatest(1, least(n, CAST(ceil(t.total / 20.0) AS BIGINT))) AS page, greatest(1, CAST(ceil(t.total / 20.0) AS BIGINT)) AS pages
        FROM (SELECT r_regionkey * 40 - 3 AS n FROM {region}) a CROSS JOIN (SELECT count(*) AS total FROM {orders} WHERE o_totalprice > 200000) t""",
    "truncate_disclosed": """SELECT least(count(*), 500) AS shown, greatest(count(*) - 500, 0) AS truncated FROM {documents} WHERE lang = 'en'""",
    "longest_name_first": """SELECT p_partkey, length(p_name) AS n FROM {part} ORDER BY length(p_name) DESC, p_partkey LIMIT 40""",
    "timeline": f"""SELECT target_id, y, dense_rank() OVER (ORDER BY y) AS year_rank FROM (SELECT DISTINCT target_id, 2015 + CAST(floor(source_id / 365.0) AS BIGINT) AS y FROM {EDGES} e) t""",
    # Graph, traces, streams as batches
    "edge_unresolved": f"""SELECT e.source_id, e.target_id FROM {EDGES} e LEFT ANTI JOIN (SELECT doc_id FROM {{documents}} WHERE lang = 'en') d ON e.target_id = d.doc_id""",
    "blanket_guard": f"""SELECT target_id, count(*) AS n FROM {EDGES} e GROUP BY target_id HAVING count(*) <= 80""",
    "tail_after_sequence": """SELECT event_id, event_type FROM {events} WHERE event_id > 9000 ORDER BY event_id LIMIT 100""",
    "manifest_diff": """SELECT a.id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'size' END AS why FROM (SELECT doc_id AS id, n_chars AS size FROM {documents}) a
        LEFT JOIN (SELECT doc_id AS id, n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS size FROM {documents} WHERE doc_id % 11 <> 0) b ON a.id = b.id WHERE b.id IS NULL OR a.size <> b.size""",
    "pending_scan": """SELECT o.o_orderkey FROM {orders} o LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad FROM {lineitem} GROUP BY l_orderkey) l
        ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL OR l.bad = 1""",
    "feature_batch_skips": """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 300 THEN 'gap' WHEN l.doc_id IS NOT NULL THEN 'done' ELSE 'run' END AS reason
        FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id) t GROUP BY reason""",
    "latest_success": """SELECT max(event_id) AS latest, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS last_success FROM {events}""",
    "trace_deletes": """SELECT e.event_id FROM {events} e LEFT ANTI JOIN (SELECT DISTINCT user_id FROM {events} WHERE value > 200) r ON e.user_id = r.user_id""",
    "orphan_traces": """SELECT DISTINCT e.user_id FROM {events} e LEFT ANTI JOIN {conversations} c ON e.user_id = c.conv_id""",
    "workspace_order": """SELECT c_custkey FROM {customer} ORDER BY CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1 END, c_nationkey, c_custkey LIMIT 60""",
}

STRENGTH = {"supersedes": 4, "amends": 3, "adds_to": 2, "clarifies": 1}


class Tables:
    """The tables below a folder, and the edges and parts that queries take from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def edges(self) -> DataFrame:
        d = F.col("doc_id")
        kind = F.when(d % 5 == 0, "amends").when(d % 5 == 1, "supersedes").when(d % 5 == 2, "clarifies").when(d % 5 == 3, "adds_to").when(d % 3 == 0, "cancels").otherwise("references")
        return self.documents.where("doc_id > 96").select(d.alias("source_id"), (d % 97).alias("target_id"), kind.alias("kind"))


def day(column: str):
    return F.col(column).cast("date").cast("string")


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def filter_set(t):
    return O.matching(t.documents, any_of={"lang": ["en", "fr"]}, between={"n_chars": (200, 20000)}, having={"source": "src1"}, where=[F.col("source").isNotNull()]).select("doc_id", "source", "lang")


def allow_sets(t):
    return O.matching(t.orders, any_of={"o_orderstatus": ["O", "F"]}, years={"o_orderdate": (1993, 1997)}, where=[F.col("o_totalprice") > 1000]).select("o_orderkey", "o_orderstatus")


def cli_scope(t):
    rows = O.matching(t.orders, having={"o_orderpriority": ["urgent", "high"]}, years={"o_orderdate": [1994, 1996]})
    return O.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50).select("o_orderkey", "o_orderpriority", day("o_orderdate").alias("day"))


def value_range_filter(t):
    return O.matching(t.lineitem, equals={"l_returnflag": "R"}, between={"l_quantity": (10, 20)}, where=[F.col("l_discount") > 0.05]).select("l_orderkey", "l_linenumber", "l_quantity")


def freshness_predicate(t):
    return t.benchmark.select("item_id", O.contains("text", [" the latest ", "current", "newest"]).cast("int").alias("wants_newest"))


def null_or_kind(t):
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return rows.where(F.col("kind").isNull() | (F.col("kind") == "click"))


def summary_projection(t):
    return t.documents.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("department"), (F.col("n_chars") > 1000).alias("is_long"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("label"))


def entity_projection(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce("l_returnflag", F.lit("-")).alias("comparator"), (F.col("l_linestatus") == "O").alias("in_force"))


def column_pruning(t):
    return O.matching(t.orders, where=[F.col("o_totalprice") > 300000]).select("o_orderkey", "o_totalprice")


def contains_any_column(t):
    return O.having_any(t.customer, {"c_name": "99", "c_mktsegment": "build"}).select("c_custkey")


def browse_department_year(t):
    return O.matching(t.orders, equals={"o_orderpriority": "1-URGENT"}, years={"o_orderdate": [1995]}).select("o_orderkey", "o_totalprice")


def browse_recent(t):
    return O.page(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 25).select("o_orderkey")


def trace_filter(t):
    return O.matching(t.events, equals={"event_type": "click"}, where=[F.col("user_id").isin(3, 17) | (F.col("event_id") == 3)]).select("event_id", "user_id")


def session_visibility(t):
    seen = O.present(t.conversations, O.matching(t.labels, equals={"toxic": 1}), {"conv_id": "doc_id"}, missing=True)
    return O.page(O.rolled_up(seen, ["conv_id"], last_turn=F.max("turn")), [F.desc("last_turn"), F.asc("conv_id")], 50)


def value_query_star(t):
    facts = O.matching(t.lineitem, where=[F.col("l_quantity") > 45])
    rows = O.star(facts, [(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "l_orderkey"), (t.part.select("p_partkey", "p_brand"), "p_partkey", "l_partkey"), (t.supplier.select("s_suppkey", "s_name"), "s_suppkey", "l_suppkey")])
    return rows.select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand", "s_name")


def left_join_current(t):
    return O.children(t.documents.select("doc_id"), O.matching(t.labels, equals={"toxic": 0}), "doc_id", "doc_id", quality=F.max("quality"))


def inner_join_pending(t):
    orders = O.matching(t.orders, equals={"o_orderpriority": "2-HIGH"}).select("o_orderkey", "o_orderdate")
    rows = t.lineitem.where("l_returnflag <> 'N'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where("l_shipdate > o_orderdate").select("l_orderkey", "l_linenumber")


def parent_children_counts(t):
    rows = O.children(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", children=F.count("l_linenumber"), last_child=F.max("l_linenumber"))
    return rows.select("o_orderkey", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("last_child", F.lit(0)).alias("last_child"))


def semi_join_filter(t):
    return O.present(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 49"), {"o_orderkey": "l_orderkey"})


def anti_join_new(t):
    return O.present(t.documents.select("doc_id"), t.labels, {"doc_id": "doc_id"}, missing=True)


def delist_missing(t):
    return O.marked(t.documents.select("doc_id"), t.labels, "doc_id", "doc_id", "delisted", 0, 1)


def not_exists_stub(t):
    return O.present(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 250000"), {"c_custkey": "o_custkey"}, missing=True)


def reconcile_full_outer(t):
    expected = t.documents.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.ceil(F.col("n_chars") / 1000).alias("expected"))
    return reconcile(expected, O.rolled_up(t.embeddings, [F.col("vec_id").alias("id")], stored=F.count("*")))


def lookup_join(t):
    return O.star(t.supplier, [(t.nation, "n_nationkey", "s_nationkey"), (t.region, "r_regionkey", "n_regionkey")]).select("s_suppkey", "n_name", "r_name")


def label_by_discriminator(t):
    rows = O.star(t.events, [(t.documents.select("doc_id", "source"), "doc_id", "user_id"), (t.customer.select("c_custkey", "c_name"), "c_custkey", "user_id")])
    return rows.select("event_id", F.when(F.col("event_type") == "click", F.col("source")).otherwise(F.col("c_name")).alias("label"))


def edge_endpoints(t):
    return O.named_ends(t.edges, t.documents, "doc_id", "lang", "source_lang", "target_lang").select("source_id", "target_id", "kind", "source_lang", "target_lang")


def self_join_label(t):
    parents = t.documents.select(F.col("doc_id").alias("parent"), F.col("source").alias("parent_source"))
    rows = t.documents.where("doc_id > 12").withColumn("parent", F.col("doc_id") % 13).join(O.small_side(parents, O.DIMENSION), "parent")
    return rows.select("doc_id", F.concat("parent_source", F.lit(" - "), "source").alias("label"))


def multi_key_join(t):
    keys = t.pages.select(F.col("page_id").alias("same_id"), F.explode(F.array(F.lower("url"), F.lower(F.concat("url", F.lit("/"))))).alias("key"))
    return t.pages.select("page_id", F.lower("url").alias("key")).join(keys, "key").select("page_id", "same_id").distinct()


def asof_latest(t):
    rows = t.lineitem.select("l_partkey", "l_orderkey").join(t.orders.where(F.col("o_orderdate") <= at("1996-06-30 00:00:00")).select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return O.first_of(rows, ["l_partkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("l_partkey", "o_orderkey")


def candidate_union(t):
    arms = [t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("rank")), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("rank")), t.labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(0).alias("rank"))]
    return O.united(arms)


def union_candidates_truncated(t):
    both = O.with_provenance(t.documents.where("lang = 'de'").select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("score")))
    return O.page(both, [F.desc("lexical"), F.desc("semantic"), F.asc("id")], 100)


def set_difference(t):
    return t.documents.select("doc_id").subtract(t.embeddings.select(F.col("vec_id").alias("doc_id")))


def intersection_counts(t):
    return t.documents.select("doc_id").intersect(t.embeddings.select("vec_id")).agg(F.count("*").alias("n"))


def multi_source_priority(t):
    of = lambda kind, total: O.rolled_up(t.events.where(F.col("event_type") == kind), [F.col("user_id").alias("k")], v=F.round(total, 3))
    return O.preferred([of("click", F.max("value")), of("view", F.sum("value"))], "k")


def round_robin(t):
    return O.interleaved(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("arm")), "arm", [F.asc("id")], 40)


def coverage_conditional_counts(t):
    return O.rolled_up(t.documents, [], total=F.count("*"), departments=F.count_distinct("source"), english=F.count_if(F.col("lang") == "en"), long_ones=F.count_if(F.col("n_chars") > 5000), shortest=F.min("n_chars"), longest=F.max("n_chars"))


def dept_facet(t):
    return O.facet(t.documents, "source", "source").orderBy("source")


def year_facet(t):
    return O.facet(O.matching(t.orders, equals={"o_orderpriority": "3-MEDIUM"}, where=[F.col("o_orderdate").isNotNull()]), F.year("o_orderdate"), "y").orderBy(F.desc("y"))


def status_facet(t):
    return O.facet(t.orders, "o_orderstatus", "status", "unknown")


def type_facet(t):
    return O.facet(t.part.where("p_type <> ''"), "p_type", "p_type").orderBy(F.desc("n"), "p_type")


def index_overview(t):
    return O.rolled_up(t.events, ["event_type"], n=F.count("*"), large=F.count_if(F.col("value") > 50), newest=F.max("event_id"))


def run_history(t):
    rows = t.events.select("event_id", "user_id", F.coalesce("event_type", F.lit("circulars")).alias("kind"))
    return O.page(rows, [F.desc("event_id")], 20)


def distinct_departments(t):
    return O.rolled_up(t.orders, [], n=F.count_distinct("o_orderpriority"))


def min_max_latest(t):
    rows = O.rolled_up(t.orders, ["o_orderpriority"], first=F.min("o_orderdate"), last=F.max("o_orderdate"), last_key=F.max("o_orderkey"))
    return rows.select("o_orderpriority", day("first").alias("first_day"), day("last").alias("last_day"), "last_key")


def trace_rollup(t):
    return O.rolled_up(t.events, [F.col("user_id").alias("trace_id")], events=F.count("*"), payload_bytes=F.coalesce(F.sum(F.length("props")), F.lit(0)), last_event=F.max("event_id"), kinds=F.count_distinct("event_type"))


def ledger_status(t):
    return O.facet(t.documents, F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") % 3 == 0, "indexed").otherwise("stale"), "status")


def status_rollup(t):
    return graph.status_rollup(t.documents.select(F.col("doc_id").alias("id")), t.edges).withColumnRenamed("id", "doc_id")


def in_out_degree(t):
    return O.degrees(t.documents, t.edges, "doc_id")


def relation_grouping(t):
    return O.rolled_up(t.edges, ["target_id", "kind"], n=F.count("*"), first_source=F.min("source_id"))


def latest_per_metric_subject(t):
    return O.first_of(t.lineitem, ["l_partkey", "l_suppkey"], [F.desc_nulls_last("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_partkey", "l_suppkey", "l_orderkey")


def value_query_current(t):
    rows = t.lineitem.join(t.orders.where("o_orderstatus not in ('F', 'P')").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return O.first_of(rows, ["l_partkey"], [F.desc_nulls_last("l_shipdate"), F.desc_nulls_last("o_orderdate"), F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


def strongest_link(t):
    return O.strongest(t.edges, ["target_id"], "kind", STRENGTH, [F.asc("source_id")]).select("target_id", "source_id", "kind")


def attachment_dedupe(t):
    return O.first_of(t.documents.select("source", "n_chars", "doc_id", "lang"), ["source", "n_chars"], [F.when(F.col("lang") == "en", 0).otherwise(1), F.asc("doc_id")]).select("source", "n_chars", "doc_id")


def rater_scores(t):
    rows = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id")
    capped = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 25).otherwise(60 + F.col("n_chars") % 40)
    return O.rolled_up(rows, ["source"], score=F.round(F.avg(capped), 4), gated=F.count_if(F.col("toxic") == 1))


def rater_agreement(t):
    return O.rolled_up(t.labels, [], cells=F.count("*"), agreed=F.count_if(F.col("quality") == 1 - F.col("toxic")))


def paired_wins(t):
    raters = sorted(r["label"] for r in t.embeddings.select("label").distinct().collect())  # the raters: a handful
    return O.paired_wins(t.embeddings, F.col("vec_id") % 25, "label", "vec_id", raters)


def inventory_coverage(t):
    rows = O.star(t.documents.select("doc_id"), [(t.embeddings.select("vec_id", F.lit(1).alias("has")), "vec_id", "doc_id"), (t.labels.select("doc_id", "quality"), "doc_id", "doc_id")])
    return O.rolled_up(rows, [], in_scope=F.count("*"), indexed=F.count("has"), gap=F.count("*") - F.count("has"), included=F.count_if(F.col("quality") == 1))


def first_appearance_rank(t):
    return O.ranked_values(O.rolled_up(t.embeddings, [F.col("label").alias("owner")], min_pos=F.min("vec_id")), "min_pos", "rank")


def evidence_top3(t):
    return O.numbered(t.embeddings.select(F.col("label").alias("owner"), "vec_id"), ["owner"], [F.asc("vec_id")], "r", 3)


def rolling_sum(t):
    return O.rolling(t.events, ["user_id"], "event_id", (F.col("value") > 50).cast("int"), 25, "hits").select("user_id", "event_id", "hits")


def carry_forward(t):
    return O.last_before(t.events, ["user_id"], "event_id", F.when(F.col("event_type") == "click", F.col("event_id")), "last_click").select("user_id", "event_id", "last_click")


def occurrence_number(t):
    return O.numbered(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "role"], [F.asc("turn")], "occurrence")


def boundary_groups(t):
    return O.runs_of(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", "block").select("conv_id", "turn", "block")


def sequence_per_partition(t):
    return O.numbered(t.events.select("user_id", "event_id"), ["user_id"], [F.asc("event_id")], "sequence")


def history_truncate(t):
    return O.numbered(t.conversations.select("conv_id", "turn"), ["conv_id"], [F.asc("turn")], "r", 3).drop("r")


def version_currency(t):
    rows = t.lineitem.where(F.col("l_shipdate").isNull() | (F.col("l_shipdate") <= at("1996-01-01 00:00:00")))
    return O.first_of(rows, ["l_partkey"], [F.when(F.col("l_shipdate") <= at("1996-01-01 00:00:00"), 0).otherwise(1), F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


def paging_offset(t):
    return O.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40)


def date_sort_mixed(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("a"), F.when(F.col("doc_id") % 2 != 0, F.col("doc_id")).alias("b"))
    return O.page(rows, [F.coalesce("a", "b", F.lit(0)).desc(), F.asc("id")], 30).select("id")


def ordering_nulls_last(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("k"))
    return O.page(rows, [F.desc_nulls_last("k"), F.asc("id")], 1000)


def two_key_sort(t):
    return O.page(t.supplier, [F.asc("s_nationkey"), F.desc("s_name")], 60).select("s_suppkey", "s_nationkey")


def arm_top_k(t):
    rows = t.documents.select(F.col("lang").alias("arm"), F.col("doc_id").alias("id"), "n_chars")
    return O.numbered(rows, ["arm"], [F.desc("n_chars"), F.asc("id")], "r", 10).select("arm", "id", "r")


def page_clamp(t):
    total = O.rolled_up(t.orders.where("o_totalprice > 200000"), [], total=F.count("*"))
    return O.page_number(t.region.select((F.col("r_regionkey") * 40 - 3).alias("n")), "n", total, 20)


def truncate_disclosed(t):
    return O.disclosed(t.documents.where("lang = 'en'"), 500)


def longest_name_first(t):
    rows = t.part.select("p_partkey", F.length("p_name").alias("n"))
    return O.page(rows, [F.desc("n"), F.asc("p_partkey")], 40)


def timeline(t):
    rows = t.edges.select("target_id", (F.lit(2015) + F.floor(F.col("source_id") / 365)).cast("long").alias("y")).distinct()
    return O.ranked_values(rows, "y", "year_rank").select("target_id", "y", "year_rank")


def edge_unresolved(t):
    return O.present(t.edges, t.documents.where("lang = 'en'"), {"target_id": "doc_id"}, missing=True).select("source_id", "target_id")


def blanket_guard(t):
    return O.rolled_up(t.edges, ["target_id"], n=F.count("*")).where("n <= 80")


def tail_after_sequence(t):
    return O.page(t.events.where("event_id > 9000").select("event_id", "event_type"), [F.asc("event_id")], 100)


def manifest_diff(t):
    size = F.col("n_chars") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    return O.file_differences(t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size")), t.documents.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), size.alias("size")))


def pending_scan(t):
    rows = O.children(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", bad=F.max((F.col("l_returnflag") == "R").cast("int")))
    return rows.where("bad is null or bad = 1").select("o_orderkey")


def feature_batch_skips(t):
    rows = O.marked(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id", "doc_id", "have", "done", "run")
    return O.facet(rows, F.when(F.col("n_chars") < 300, "gap").otherwise(F.col("have")), "reason")


def latest_success(t):
    return O.rolled_up(t.events, [], latest=F.max("event_id"), last_success=F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))))


def trace_deletes(t):
    return O.present(t.events.select("event_id", "user_id"), t.events.where("value > 200"), {"user_id": "user_id"}, missing=True).select("event_id")


def orphan_traces(t):
    return O.present(t.events.select("user_id").distinct(), t.conversations, {"user_id": "conv_id"}, missing=True)


def workspace_order(t):
    return O.page(t.customer, [F.when(F.col("c_custkey") % 50 == 0, 0).otherwise(1), F.asc("c_nationkey"), F.asc("c_custkey")], 60).select("c_custkey")


def _registered(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))


QUERIES = {name: _registered(globals()[name]) for name in SQL}
ORACLE = {name: duckdb_query(text).replace("LEFT ANTI JOIN", "ANTI JOIN") for name, text in SQL.items()}
