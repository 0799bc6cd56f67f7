"""Digest trees: equal roots for equal rows, and a comparison that reads unequal leaves alone."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators.digest_tree import DigestTree

FIELDS = "id long, a string, b string"


def tree(spark, folder, rows, depth=2):
    frame = spark.createDataFrame(rows, FIELDS) if isinstance(rows, list) else rows
    return DigestTree(spark, f"file://{folder}").build(frame, "id", ["a", "b"], depth)


def test_rows_in_any_order_have_one_root(spark, tmp_path):
    rows = spark.range(3000).select("id", F.col("id").cast("string").alias("a"), F.when(F.col("id") % 3 > 0, "x").alias("b"))
    here, there = tree(spark, tmp_path / "a", rows), tree(spark, tmp_path / "b", rows.orderBy(F.rand(1)).repartition(7))
    assert here.root() == there.root() and len(here.root()) == 64
    assert here.diff(there).collect() == []


def test_a_comparison_reads_the_leaves_of_changed_keys_alone(spark, tmp_path):
    rows = spark.range(20000).select("id", F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    changed = rows.where("id <> 77").withColumn("b", F.when(F.col("id") == 4321, "y").otherwise(F.col("b"))).unionByName(spark.createDataFrame([(-5, "n", "x")], FIELDS))
    here, there = tree(spark, tmp_path / "a", rows, 3), tree(spark, tmp_path / "b", changed, 3)
    assert sorted(map(tuple, here.diff(there).collect())) == [(-5, "new"), (77, "gone"), (4321, "changed")]
    assert [level.count() for level in here.unequal(there)] == [1, 3, 3, 3]
    assert here.level(3).count() > 3500
    plan = here.diff(there)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(leaf" in plan


@pytest.mark.parametrize("many", [False, True])
def test_nulls_repeated_rows_and_borders_between_columns(spark, tmp_path, monkeypatch, many):
    if many:
        monkeypatch.setattr("lexweave.operators.digest_tree.NAMED_LEAVES", 0)
    old = [(1, None, "x"), (2, "", "x"), (3, "ab", "c"), (4, "t", "t"), (4, "t", "t"), (5, "p", "q"), (5, "r", "s"), (None, "a", "b"), (6, "~", None)]
    new = [(1, "", "x"), (2, "", "x"), (3, "a", "bc"), (4, "t", "t"), (5, "r", "s"), (5, "p", "q"), (6, None, "~")]
    found = tree(spark, tmp_path / "a", old).diff(tree(spark, tmp_path / "b", new))
    assert sorted(map(tuple, found.collect())) == [(1, "changed"), (3, "changed"), (4, "changed"), (6, "changed")]


def test_empty_tables_and_other_depths(spark, tmp_path):
    none = tree(spark, tmp_path / "none", [])
    some = tree(spark, tmp_path / "some", [(1, "a", "b")])
    assert none.root() is None and none.diff(none).collect() == []
    assert list(map(tuple, none.diff(some).collect())) == [(1, "new")]
    with pytest.raises(ValueError):
        none.diff(tree(spark, tmp_path / "deep", [(1, "a", "b")], 3))
