"""Ordered folds that no built-in aggregate expresses, a group at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def consolidate(changes: DataFrame) -> DataFrame:
    """Change lists (chain, position, source, action, req_id, requirement) folded into the state of requirements.

    ``add`` needs a text and an id not there yet; ``modify`` and ``remove`` pass
    over ids that are unknown or removed; what was added stays "added" when
    modified later. A requirement's state follows from its own changes alone: it
    begins with its first addition and ends with the first removal after it, so
    windows take the place of the fold. Positions of one requirement differ.
    """
    own = Window.partitionBy("chain", "req_id")
    texted = F.coalesce(F.length("requirement"), F.lit(0)) > 0
    begun = changes.withColumn("_start", F.min(F.when((F.col("action") == "add") & texted, F.col("position"))).over(own)).where("position >= _start")
    ended = begun.withColumn("_end", F.min(F.when((F.col("action") == "remove") & (F.col("position") > F.col("_start")), F.col("position"))).over(own)).where("_end is null or position <= _end")
    first = F.col("position") == F.col("_start")
    modified = (F.col("action") == "modify") & texted & ~first
    said = F.when(first | modified, F.struct("position", "requirement"))
    found = ended.groupBy("chain", "req_id").agg(
        F.max(said)["requirement"].alias("requirement"), F.max(F.when(first, F.col("source"))).alias("origin"), F.count_if(modified).alias("n"), F.max("_end").isNotNull().alias("removed"), F.max("_start").alias("start")
    )
    status = F.when(F.col("removed"), "removed").when(F.col("start") != 0, "added").when(F.col("n") > 0, "modified").otherwise("original")
    return found.select("chain", "req_id", "requirement", status.alias("status"), "origin", (1 + F.col("n") + F.col("removed").cast("int")).cast("int").alias("history"))


def greedy_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit; one that does not fit is passed over. Sizes are at least 1.

    Room only shrinks, so of the rows of one size those that are taken are the
    first ones, and at most ``budget / size`` of them. All others go before the
    fold, whose group is then bounded by the budget, whatever a group's rows.
    """
    schema = rows.schema
    nth = F.row_number().over(Window.partitionBy(group, size).orderBy(order))
    few = rows.where(F.col(size).between(1, budget)).withColumn("_nth", nth).where(F.col("_nth") <= budget).where(F.col("_nth") * F.col(size) <= budget).drop("_nth")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        pdf = pdf.sort_values(order, kind="stable")
        for n in pdf[size]:
            keep.append(n <= left)
            left -= n if n <= left else 0
        return pdf[keep]

    return few.groupBy(group).applyInPandas(fold, schema)


def prefix_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows taken in order until one does not fit; that one ends the group.

    A row of a size takes one at least, so a group ends among its first
    ``budget + 1`` such rows: only these are put in order, and each task passes on no
    more of a group, whatever the group's rows.
    """
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    few = rows.where(F.col(size) >= 1).select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col(size).alias("_size"), nth.alias("_nth")).where(F.col("_nth") <= budget + 1)
    taken = F.sum("_size").over(Window.partitionBy("_group").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = few.withColumn("_taken", taken).where(F.col("_taken") > budget).groupBy("_group").agg(F.min("_order").alias("_end"))
    return rows.join(ends, rows[group].eqNullSafe(ends["_group"]), "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_group", "_end")
