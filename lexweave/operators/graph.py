"""Closures and searches over a relation graph, level by level.

A level is one join of the frontier with the edges and one anti join with what
is reached; each level is a written table, so its lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import settled


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, level): what each seed reaches along edges (a, b); the seed itself is at level 0.

    Cycles end by themselves; ``depth`` bounds the levels.
    """
    steps = edges.select("a", "b").where("a is not null and b is not null").distinct()
    found = frontier = settled(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).cast("long").alias("level")).distinct())
    level = 0
    while depth is None or level < depth:
        level += 1
        near = frontier.join(steps, frontier["node"] == steps["a"]).select("seed", F.col("b").alias("node"), F.lit(level).cast("long").alias("level")).distinct()
        frontier = settled(near.join(found, ["seed", "node"], "left_anti"))
        if not frontier.take(1):
            break
        found = found.unionByName(frontier)
    return found


CHAIN_KINDS = ("amends", "adds_to")
#: A chain of more members is no chain of amendments; it is left out whole.
CHAIN_MEMBERS = 50


def chain(edges: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] = CHAIN_KINDS) -> DataFrame:
    """(seed, node): all that a seed amends, directly or not, and all that amends any of these; nothing that an amender amends besides."""
    typed = edges.where(F.col("kind").isin(*kinds) & F.col("target_id").isNotNull())
    up = reach(typed.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), seeds).select("seed", "node")
    steps = typed.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")).where("a is not null and b is not null").distinct()
    found = frontier = settled(up)
    while frontier.take(1):
        near = frontier.join(steps, frontier["node"] == steps["a"]).select("seed", F.col("b").alias("node")).distinct()
        frontier = settled(near.join(found, ["seed", "node"], "left_anti"))
        found = found.unionByName(frontier)
    return found


def chain_members(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, node, position, base): members of chains of 2 to ``CHAIN_MEMBERS``, oldest first; the first names the chain.

    Nodes are rows (id, day); a member without a day is the oldest, ties go by id.
    """
    known = chains.join(nodes.select(F.col("id").alias("node"), "day"), "node")
    size = known.groupBy("seed").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("day").isNotNull().alias("dated"), "day", "node"))).alias("members")).where(F.col("n").between(2, CHAIN_MEMBERS))
    rows = size.select("seed", F.col("members")[0]["node"].alias("base"), F.posexplode("members").alias("position", "m"))
    return rows.select("seed", F.col("m.node").alias("node"), F.col("position").cast("long").alias("position"), "base")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, level) by edges in either direction."""
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return reach(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), seeds, depth)


# What an edge makes of its target, weakest first; any other kind amends it.
STATUSES = ("active", "amended", "superseded", "cancelled")
KIND_STATUS = {"supersedes": "superseded", "cancels": "cancelled"}


def status_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, status): the strongest that the resolved edges into each node make of it; active without any."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kind, status in KIND_STATUS.items() for x in (kind, STATUSES.index(status))])[F.col("kind")], F.lit(STATUSES.index("amended")))
    strongest = edges.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.max(rank).alias("rank"))
    return nodes.join(strongest, "id", "left").select("id", F.get(F.array(*[F.lit(s) for s in STATUSES]), F.coalesce("rank", F.lit(0))).alias("status"))


def resolve(edges: DataFrame, nodes: DataFrame, keys: list[str] | str = "reference", year: str | None = None) -> DataFrame:
    """Edges with ``target_id`` filled where exactly one other node has the edge's keys; the source itself is no match.

    ``year`` names a column that must agree too, unless the edge has none. A
    node's rows with equal keys count once.
    """
    keys = [keys] if isinstance(keys, str) else keys
    listed = nodes.select(F.col("id").alias("found"), *keys, *([F.col(year).alias("_year")] if year else [])).distinct()
    # Two ids of each key (and year) tell whether there is one match besides the source.
    ids = lambda *by: listed.groupBy(*by).agg(F.count_distinct("found").alias("n"), F.min("found").alias("low"), F.max("found").alias("high"))
    other = F.when(F.col("n") == 1, F.when(~F.col("low").eqNullSafe(F.col("source_id")), F.col("low"))).when(F.col("n") == 2, F.when(F.col("low") == F.col("source_id"), F.col("high")).when(F.col("high") == F.col("source_id"), F.col("low")))
    filled = lambda frame: frame.withColumn("target_id", F.coalesce("target_id", other)).drop("n", "low", "high", "_year")
    if year is None:
        return filled(edges.join(ids(*keys), keys, "left"))
    dated = edges.where(F.col(year).isNotNull()).withColumn("_year", F.col(year)).join(ids(*keys, "_year"), [*keys, "_year"], "left")
    undated = edges.where(F.col(year).isNull()).join(ids(*keys), keys, "left").withColumn("_year", F.lit(None))
    return filled(dated.select(*undated.columns)).unionByName(filled(undated))
