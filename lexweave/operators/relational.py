"""Filters, joins, unions, roll-ups, ranked windows and pages that the corpus queries are made of.

All are compositions of DataFrame operations, so that filters and columns reach
the scan and Catalyst picks the joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.retrieval import small_side

#: Rows of a dimension that go to every task by broadcast.
DIMENSION = 100_000


def contains(column: str, words: str | Sequence[str]) -> Column:
    """Whether a column has one of some words, case aside."""
    listed = [words] if isinstance(words, str) else list(words)
    return reduce(or_, [F.lower(F.col(column)).contains(w.lower()) for w in listed])


def matching(frame: DataFrame, equals: dict | None = None, any_of: dict | None = None, between: dict | None = None, having: dict | None = None, years: dict | None = None, where: Sequence[Column] = ()) -> DataFrame:
    """Rows that meet every condition that is given; a condition of None is none.

    ``between`` has closed ranges whose ends may be None; ``having`` has words of
    which a column must contain one; ``years`` has lists or ranges of years.
    """
    tests = [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    tests += [F.col(c).isin(*v) for c, v in (any_of or {}).items() if v]
    for c, (low, high) in (between or {}).items():
        tests += [F.col(c) >= low] if low is not None else []
        tests += [F.col(c) <= high] if high is not None else []
    tests += [contains(c, words) for c, words in (having or {}).items() if words]
    for c, wanted in (years or {}).items():
        tests.append(F.year(c).isin(*wanted) if isinstance(wanted, list | set) else F.year(c).between(*wanted))
    return frame.where(reduce(and_, [*tests, *where])) if tests or where else frame


def having_any(frame: DataFrame, words: dict[str, str | Sequence[str]]) -> DataFrame:
    """Rows where any of the columns contains its words."""
    return frame.where(reduce(or_, [contains(c, w) for c, w in words.items()]))


def page(frame: DataFrame, order: Sequence[Column], size: int, offset: int = 0) -> DataFrame:
    """A page of the rows in order: a limit that Spark takes of every task before it merges."""
    ordered = frame.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(size)


def page_number(asked: DataFrame, number: str, total: DataFrame, size: int) -> DataFrame:
    """(asked, page, pages): page numbers brought between 1 and the last page; ``total`` is one row (total)."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return asked.crossJoin(F.broadcast(total)).select(F.col(number).alias("asked"), F.greatest(F.lit(1), F.least(F.col(number), pages)).cast("long").alias("page"), pages.alias("pages"))


def disclosed(frame: DataFrame, size: int) -> DataFrame:
    """(shown, truncated): how many rows a list of ``size`` shows, and how many it leaves out."""
    return frame.agg(F.count("*").alias("n")).select(F.least("n", F.lit(size)).alias("shown"), F.greatest(F.col("n") - size, F.lit(0)).alias("truncated"))


def numbered(frame: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, keep: int | None = None) -> DataFrame:
    """Rows numbered from 1 in each group; with ``keep`` the first ones alone, which Spark cuts before the shuffle."""
    found = frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return found if keep is None else found.where(F.col(name) <= keep)


def first_of(frame: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return numbered(frame, by, order, "_first", 1).drop("_first")


def strongest(edges: DataFrame, by: Sequence[str], kind: str, ranks: dict[str, int], order: Sequence[Column]) -> DataFrame:
    """The row of the strongest kind in each group; kinds without a rank are the weakest."""
    return first_of(edges, by, [rank_of(F.col(kind), ranks).desc(), *order])


def rank_of(kind: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[kind], F.lit(0))


def rolled_up(frame: DataFrame, by: Sequence[str | Column], **totals: Column) -> DataFrame:
    """Totals of each group by name, or of all rows."""
    return frame.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])


def facet(frame: DataFrame, value: str | Column, name: str, unknown: str | None = None) -> DataFrame:
    """(name, n): how often each value occurs."""
    column = F.col(value) if isinstance(value, str) else value
    return frame.groupBy((F.coalesce(column, F.lit(unknown)) if unknown is not None else column).alias(name)).agg(F.count("*").alias("n"))


def present(frame: DataFrame, other: DataFrame, on: dict[str, str], missing: bool = False) -> DataFrame:
    """Rows whose keys another table has, or with ``missing`` those whose keys it lacks; null keys are never there."""
    keys = other.select(*[F.col(b).alias(f"_{b}") for b in on.values()])
    test = reduce(and_, [F.col(a) == F.col(f"_{b}") for a, b in on.items()])
    return frame.join(keys, test, "left_anti" if missing else "left_semi")


def marked(frame: DataFrame, other: DataFrame, key: str, other_key: str, name: str, there: object, absent: object) -> DataFrame:
    """Rows with ``name``: one value where another table has the key, another where not."""
    keys = other.select(F.col(other_key).alias(key)).distinct().withColumn("_there", F.lit(True))
    return frame.join(keys, key, "left").withColumn(name, F.when(F.col("_there"), F.lit(there)).otherwise(F.lit(absent))).drop("_there")


def star(facts: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Facts with each dimension (table, its key, the fact's key) on the left; small dimensions are broadcast."""
    for table, key, fact_key in dimensions:
        facts = facts.join(small_side(table, DIMENSION), facts[fact_key] == table[key], "left").drop(table[key]) if key != fact_key else facts.join(small_side(table, DIMENSION), key, "left")
    return facts


def children(parents: DataFrame, rows: DataFrame, key: str, row_key: str, **totals: Column) -> DataFrame:
    """Parents with totals of their children, added up before they meet; parents without any keep nulls."""
    summed = rows.groupBy(F.col(row_key).alias(key)).agg(*[c.alias(n) for n, c in totals.items()])
    return parents.join(summed, key, "left")


def named_ends(edges: DataFrame, nodes: DataFrame, key: str, value: str, source: str, target: str) -> DataFrame:
    """Edges (source_id, target_id, …) whose ends are known, with a value of each end."""
    a = nodes.select(F.col(key).alias("source_id"), F.col(value).alias(source))
    b = nodes.select(F.col(key).alias("target_id"), F.col(value).alias(target))
    return edges.join(a, "source_id").join(b, "target_id")


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, outgoing, incoming) of every node."""
    count = lambda end, name: edges.groupBy(F.col(end).alias(key)).agg(F.count("*").alias(name))
    found = nodes.select(key).join(count("source_id", "outgoing"), key, "left").join(count("target_id", "incoming"), key, "left")
    return found.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outgoing", "incoming")])


def united(arms: Sequence[DataFrame]) -> DataFrame:
    """(id, best_rank, arms): candidates of several arms (id, rank), with their best rank and how many rows found them."""
    rows = reduce(DataFrame.unionByName, [a.select("id", F.col("rank").cast("long").alias("rank")) for a in arms])
    return rows.groupBy("id").agg(F.min("rank").alias("best_rank"), F.count("*").alias("arms"))


def with_provenance(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(id, lexical, semantic): ids of either arm, a mark for those of the first, and the score of the second or 0."""
    both = lexical.select("id", F.lit(1).alias("lexical")).join(semantic.select("id", F.col("score").alias("semantic")), "id", "full_outer")
    return both.select("id", F.coalesce("lexical", F.lit(0)).alias("lexical"), F.coalesce("semantic", F.lit(0)).alias("semantic"))


def preferred(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, where each key is taken from the first source that has it."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    values = [c for c in sources[0].columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*values), "_source").alias("v")).select(key, *[F.col("v")[c].alias(c) for c in values])


def interleaved(arms: DataFrame, arm: str, order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` rows when arms take turns; no arm gives more than ``size``, so the rest goes before the sort."""
    return page(numbered(arms, [arm], order, "turn", size), [F.asc("turn"), F.asc(arm)], size)


def rolling(frame: DataFrame, by: Sequence[str], order: str, value: Column, rows: int, name: str) -> DataFrame:
    """Sums over each row and the ``rows - 1`` before it."""
    return frame.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)))


def last_before(frame: DataFrame, by: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null of the rows before each."""
    return frame.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))


def runs_of(frame: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Rows with the number of the run of equal values that they belong to."""
    window = Window.partitionBy(*by).orderBy(order)
    changed = F.when(F.col(value) == F.lag(value).over(window), 0).otherwise(1)
    return frame.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def ranked_values(frame: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the dense rank of a value over all rows.

    Only the distinct values are put in order, by tasks that each take a range;
    ranks count the values of the ranges before. So no task sorts all rows.
    """
    values = frame.select(value).where(F.col(value).isNotNull()).distinct()
    parts = values.repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    from lexweave.session import settled

    parts = settled(parts)
    ahead = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each task
    before = ahead.select(F.col("_part").alias("_earlier"), "_n")
    starts = ahead.select("_part").join(F.broadcast(before), F.col("_earlier") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_start"))
    ranked = parts.join(F.broadcast(starts), "_part").select(value, (F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(value))).alias(name))
    return frame.join(ranked, value, "left")


def paired_wins(frame: DataFrame, cell: Column, rater: str, score: str, raters: Sequence) -> DataFrame:
    """(a, b, wins, pairs): for raters a before b, how often a's score exceeds b's over all pairs of one cell.

    A running count of each rater's lower scores takes the place of the pairs, so
    the work is rows times raters.
    """
    rows = frame.select(cell.alias("_cell"), F.col(rater).alias("a"), F.col(score).alias("_score"))
    lower = Window.partitionBy("_cell").orderBy("_score").rangeBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("_cell")
    is_ = lambda b: F.when(F.col("a") == b, 1)
    counted = rows.select("a", *[F.count(is_(b)).over(lower).alias(f"w{i}") for i, b in enumerate(raters)], *[F.count(is_(b)).over(all_).alias(f"p{i}") for i, b in enumerate(raters)])
    listed = F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"w{i}").alias("wins"), F.col(f"p{i}").alias("pairs")) for i, b in enumerate(raters)])
    each = counted.select("a", F.explode(listed).alias("x")).select("a", "x.*").where("a < b and pairs > 0")
    return each.groupBy("a", "b").agg(F.sum("wins").alias("wins"), F.sum("pairs").alias("pairs"))


def file_differences(listed: DataFrame, there: DataFrame) -> DataFrame:
    """(id, why): rows (id, size) of a manifest that are missing or of another size."""
    joined = listed.join(there.select("id", F.col("size").alias("_size")), "id", "left")
    return joined.where(F.col("_size").isNull() | (F.col("_size") != F.col("size"))).select("id", F.when(F.col("_size").isNull(), "missing").otherwise("size").alias("why"))
