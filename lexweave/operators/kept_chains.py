"""Chains of amendments that are kept, and redone only where a rewritten document reaches.

A chain is what ``graph.chain`` finds for a seed: all it amends, then all that amends
any of these. As one walk, a node is first of phase 0 (upwards) and then of
phase 1 (downwards), so that a chain is plain reachability over steps.

When the edges of documents are rewritten, pairs (seed, node) that may rest on a
lost step are taken out, those with another way are put back, and what gained
steps bring is added. Every round joins only what changed in the round before;
the kept pairs are read by key of such rows. Cycles need no care: what holds
itself up alone is taken out with the rest.

Edges without either end, or of other kinds, count for nothing. A seed is the one
member of its chain without any.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.graph import CHAIN_KINDS
from lexweave.session import settled
from lexweave.sources.snapshots import SnapshotTable

OWN = "node.phase = 0 AND node.id = seed"


def steps(edges: DataFrame, kinds: tuple[str, ...] = CHAIN_KINDS) -> DataFrame:
    """(a, b): the steps that edges (source_id, target_id, kind) allow between nodes (phase, id)."""
    typed = edges.where(F.col("kind").isin(*kinds) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).select("source_id", "target_id").distinct()
    node = lambda phase, column: F.struct(F.lit(phase).alias("phase"), F.col(column).alias("id"))
    moves = F.array(*[F.struct(node(p, x).alias("a"), node(q, y).alias("b")) for p, x, q, y in ((0, "source_id", 0, "target_id"), (0, "target_id", 1, "source_id"), (1, "target_id", 1, "source_id"))])
    return typed.select(F.explode(moves).alias("move")).select("move.a", "move.b")


def _spread(first: DataFrame, near: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """All that ``near`` finds of the newest pairs, round by round; it leaves out what it is told is there."""
    frontier = settled(first)
    found = [frontier]
    while frontier.take(1):
        frontier = settled(near(frontier, reduce(DataFrame.unionByName, found)))
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def _after(pairs: DataFrame, moves: DataFrame) -> DataFrame:
    return pairs.join(moves, pairs["node"] == moves["a"]).select("seed", F.col("b").alias("node")).distinct()


PAIR = ["seed", "node"]


def maintained(reached: DataFrame, before: DataFrame, after: DataFrame, lost: DataFrame, gained: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doomed, brought) of pairs (seed, node): those taken out of ``reached`` first, and all put in then.

    ``before`` and ``after`` are all steps; ``lost`` and ``gained`` are how they differ. ``seeds``
    are new ones. The pairs afterwards are ``reached`` without ``doomed`` and with ``brought``.
    """
    doomed = _spread(_after(reached, lost).where(f"NOT ({OWN})"), lambda new, known: _after(new, before).where(f"NOT ({OWN})").join(known, PAIR, "left_anti"))
    kept = reached.join(doomed, PAIR, "left_anti")
    # A doomed pair stays if a step leads to it from a pair that was not doomed.
    ways = doomed.join(after, doomed["node"] == after["b"]).select("seed", F.col("a").alias("node"), "b")
    saved = ways.join(kept, PAIR, "left_semi").select("seed", F.col("b").alias("node")).distinct()
    back = _spread(saved, lambda new, known: _after(new, after).join(doomed, PAIR, "left_semi").join(known, PAIR, "left_anti"))
    now = kept.unionByName(back)
    own = seeds.select("seed", F.struct(F.lit(0).alias("phase"), F.col("seed").alias("id")).alias("node"))
    fresh = _after(now, gained).unionByName(own).distinct().join(now, PAIR, "left_anti")
    new = _spread(fresh, lambda new, known: _after(new, after).join(now, PAIR, "left_anti").join(known, PAIR, "left_anti"))
    return doomed, settled(back.unionByName(new))


class KeptChains:
    """The chains of all seeds over edges that are rewritten source by source; one writer at a time.

    Edges are committed first, then the pairs that follow from them. The pairs'
    version is that of the edges they belong to, so a writer that stopped between
    the two leaves edges that the next ``catch_up`` takes in.
    """

    def __init__(self, spark: SparkSession, root: str, kinds: tuple[str, ...] = CHAIN_KINDS):
        self.spark, self.kinds = spark, kinds
        self.edges, self.pairs = SnapshotTable(spark, f"{root}/edges", "source_id"), SnapshotTable(spark, f"{root}/pairs", "seed")

    def rewrite(self, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
        """Edges (source_id, target_id, kind) in place of all that the ``sources`` (source_id) had; sources become seeds. Gives (seed): the stale ones, whose chains have other members than before."""
        self.edges.replace(edges.select("source_id", "target_id", "kind"), sources)
        return self.catch_up()

    def catch_up(self) -> DataFrame:
        """Brings the pairs up to the newest edges, commit by commit."""
        stale = []
        while (at := self.pairs.log.manifest()["version"]) < self.edges.log.manifest()["version"]:
            stale.append(self._follow(at))
        none = self.edges.read().select(F.col("source_id").alias("seed")).limit(0)
        return reduce(DataFrame.unionByName, stale, none).distinct()

    def _follow(self, at: int) -> DataFrame:
        after = self.edges.read(at + 1)
        before = self.edges.read(at) if at else after.limit(0)
        [segment] = [s for s in self.edges.log.manifest(at + 1)["segments"] if s["order"] == at + 1]
        touched = self.spark.read.parquet(self.edges.log.at(segment["keys"]))
        old, new = (settled(steps(rows.join(touched, "source_id", "left_semi"), self.kinds)) for rows in (before, after))
        before, after = steps(before, self.kinds), steps(after, self.kinds)
        reached = self.pairs.read(at) if at else touched.select(F.col("source_id").alias("seed"), F.struct(F.lit(0).alias("phase"), F.col("source_id").alias("id")).alias("node")).limit(0)
        seeds = touched.select(F.col("source_id").alias("seed")).join(reached.select("seed"), "seed", "left_anti")
        doomed, brought = maintained(reached, before, after, settled(old.exceptAll(new)), settled(new.exceptAll(old)), seeds)
        moved = settled(doomed.select("seed").unionByName(brought.select("seed")).distinct())
        was = reached.join(moved, "seed", "left_semi")
        rows = settled(was.join(doomed, PAIR, "left_anti").unionByName(brought))
        members = lambda pairs: pairs.select("seed", F.col("node.id").alias("id")).distinct()
        differing = members(was).withColumn("was", F.lit(1)).join(members(rows).withColumn("is", F.lit(1)), ["seed", "id"], "full").where("was IS NULL OR is IS NULL")
        stale = settled(differing.select("seed").distinct())
        self.pairs.replace(rows, moved)
        return stale

    def chains(self) -> DataFrame:
        """(seed, node): every seed's members."""
        return self.pairs.read().select("seed", F.col("node.id").alias("node")).distinct()
