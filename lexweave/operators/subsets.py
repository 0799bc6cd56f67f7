"""Which word sets hold which: texts with equal words meet once, as a class.

A class is known by a digest of its sorted words. A wanted set meets the sets that have its
rarest word; four 64-bit filters keep out all but a few of those that lack another
one, before anything is shuffled, and the rest are compared in full. Sets of
a frequent word are dealt out over tasks, and what wants the word goes to each part.

Empty sets are held by nothing; null sets take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.retrieval import BROADCAST_TERMS, small_side
from lexweave.session import settled

#: Sets of one word that a task takes; a word of more is dealt out to several.
WORD_SETS = 10_000
FILTERS = 4


def key_of(words: Column) -> Column:
    """What equal sets of words share."""
    return F.unhex(F.md5(F.array_join(F.array_sort(words), " ")))


def _filter(words: Column, i: int) -> Column:
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(i), w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s.bitwiseOR(bit(w)))


def containing(wants: DataFrame, sets: DataFrame, word_sets: int = WORD_SETS) -> DataFrame:
    """(want_key, key): the sets (key, words) that have every word of a wanted one (want_key, want); keys are given once."""
    filters = [f"f{i}" for i in range(FILTERS)]
    # Written first: beside an explode the filters would be worked out for each word again.
    marked = settled(sets.select("key", "words", *[_filter(F.col("words"), i).alias(f) for i, f in enumerate(filters)]))
    words = marked.select("key", *filters, F.explode("words").alias("word"))
    counts = settled(sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    # A wanted word that no set has ends the match, whatever the others are.
    rare = wants.select("want_key", F.explode("want").alias("word")).join(counts, "word", "left").groupBy("want_key").agg(F.min_by(F.struct("word", "n"), F.struct(F.coalesce("n", F.lit(0)), "word")).alias("rare")).where("rare.n is not null")
    rare = settled(rare.select("want_key", "rare.word", F.ceil(F.col("rare.n") / word_sets).cast("int").alias("parts")))
    asked = settled(rare.join(wants, "want_key").select("want_key", "word", "parts", *[_filter(F.col("want"), i).alias("w" + f) for i, f in enumerate(filters)]))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = words.join(small_side(rare.select("word", "parts").distinct(), BROADCAST_TERMS), "word").withColumn("part", F.pmod(F.hash("key"), F.col("parts")))
    passes = reduce(lambda a, b: a & b, [F.col("w" + f).bitwiseAND(F.bitwise_not(F.col(f))) == 0 for f in filters])
    near = settled(asked.join(dealt, ["word", "part"]).where(passes).select("want_key", "key"))
    met = near.join(wants.select("want_key", "want"), "want_key").join(sets.select("key", "words"), "key")
    return met.where(F.size(F.array_except("want", "words")) == 0).select("want_key", "key")


def running_sum(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """Rows (by, order, value), one to each of the first two, with the sum of ``value`` up to and with them.

    No task takes a group whole: rows are dealt by range, and a part's sums go on from those of the parts before it.
    """
    dealt = settled(rows.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(by, "_part").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = F.sum(value).over(Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, within).join(before, [by, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
