"""Kept chains against chains from scratch after random rewrites."""

import random

from pyspark.sql import functions as F

from lexweave.operators import graph
from lexweave.operators.kept_chains import KeptChains

FIELDS = "source_id long, target_id long, kind string"


def chains_of(edges, nodes):
    """By plain sets: what a seed amends, then what amends any of these."""
    typed = {(a, b) for a, b, kind in edges if a is not None and b is not None and kind in graph.CHAIN_KINDS}
    found = {}
    for seed in nodes:
        members = {seed}
        for flip in (False, True):
            steps = {(b, a) for a, b in typed} if flip else typed
            while True:
                more = {b for a, b in steps if a in members} - members
                if not more:
                    break
                members |= more
        found[seed] = members
    return found


def kept_of(kept):
    found = {}
    for seed, node in kept.chains().collect():
        found.setdefault(seed, set()).add(node)
    return found


def test_random_rewrites_equal_chains_from_scratch(spark, tmp_path):
    rng = random.Random(5)
    nodes = list(range(24))
    edges = {n: [] for n in nodes}
    kept = KeptChains(spark, f"file://{tmp_path}/chains")
    before = {}
    for round_ in range(3):
        rewritten = nodes if round_ == 0 else rng.sample(nodes, 5)
        for n in rewritten:
            # Cycles, loops, repeated edges, missing ends and kinds that count for nothing.
            edges[n] = [(n, rng.choice([*nodes, None]), rng.choice(["amends", "amends", "adds_to", "cites", None])) for _ in range(rng.choice([0, 1, 1, 2]))] * rng.choice([1, 1, 2])
        rows = [e for n in rewritten for e in edges[n]]
        stale = kept.rewrite(spark.createDataFrame(rows, FIELDS), spark.createDataFrame([(n,) for n in rewritten], "source_id long"))
        now = chains_of([e for es in edges.values() for e in es], nodes)
        assert kept_of(kept) == now
        assert sorted(r.seed for r in stale.collect()) == sorted(n for n in nodes if before.get(n) != now[n])
        before = now
    whole = graph.chain(kept.edges.read(), spark.range(24).select(F.col("id").alias("seed")))
    assert sorted(map(tuple, whole.distinct().collect())) == sorted((s, n) for s, ms in now.items() for n in ms)


def test_edges_of_a_writer_that_stopped_are_taken_in(spark, tmp_path):
    kept = KeptChains(spark, f"file://{tmp_path}/chains")
    kept.rewrite(spark.createDataFrame([(1, 0, "amends"), (2, 1, "amends"), (3, 9, "amends")], FIELDS))
    kept.edges.replace(spark.createDataFrame([(2, 9, "amends")], FIELDS))
    assert kept_of(kept) == {1: {0, 1, 2}, 2: {0, 1, 2}, 3: {3, 9}}
    stale = kept.rewrite(spark.createDataFrame([], FIELDS), spark.createDataFrame([(7,)], "source_id long"))
    assert sorted(r.seed for r in stale.collect()) == [1, 2, 3, 7]
    assert kept_of(kept) == {1: {0, 1}, 2: {2, 3, 9}, 3: {2, 3, 9}, 7: {7}}
