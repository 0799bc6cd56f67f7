"""Where texts name something: spans of many names at once, the longest first, without overlap.

A name is met by its first two words (or its only one): every place of a text gives
these two keys and a window of as many words as the longest name has, in one pass. What meets is
compared in the window. Spans that overlap, directly or by others between, form a
run, and only within a run are they picked: the longest first, of these the
leftmost; what overlaps one picked before goes.

Words are those of ``canonical_words``. A name that stands for several ids gives each of
them its span. Null and empty texts and names have no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as X

#: Names up to this number are broadcast; more meet the places by a shuffle.
BROADCAST_NAMES = 50_000
SPAN = "array<struct<n:int,start:int,name:string>>"


def _words(text: Column) -> Column:
    return F.filter(F.split(X.canonical_words(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, start, n, name): every place, in words from 0, where a text (id, text) has a name's n words."""
    listed = names.select(_words(F.col("name")).alias("w")).where(F.size("w") > 0).distinct()
    listed = listed.select(F.array_join(F.slice("w", 1, 2), " ").alias("key"), (F.size("w") == 1).alias("single"), F.size("w").alias("n"), F.array_join("w", " ").alias("name"))
    size = listed.agg(F.count("*").alias("names"), F.max("n").alias("longest")).first()
    longest = size.longest or 1
    words = texts.select("id", _words(F.col("text")).alias("w"))
    window = F.transform("w", lambda _, i: F.slice("w", i + 1, longest))
    places = words.select("id", F.posexplode(window).alias("start", "window"))
    keys = F.array(F.struct(F.lit(True).alias("single"), F.col("window")[0].alias("key")), F.struct(F.lit(False).alias("single"), F.array_join(F.slice("window", 1, 2), " ").alias("key")))
    asked = places.select("id", "start", "window", F.explode(keys).alias("k")).select("id", "start", "window", "k.single", "k.key")
    met = asked.join(F.broadcast(listed) if size.names <= BROADCAST_NAMES else listed, ["single", "key"])
    return met.where(F.array_join(F.slice("window", F.lit(1), F.col("n")), " ") == F.col("name")).select("id", "start", "n", "name")


def name_spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, start, n, name_id): the spans of names (name_id, name) in texts (id, text) that stand after the longest were picked."""
    order = Window.partitionBy("id").orderBy("start", F.desc("n"))
    ends = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = candidates(texts, names).withColumn("opens", (F.col("start") >= F.coalesce(ends, F.lit(0))).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "start", "name")))
    clear = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["start"] - s["n"]) & (s["start"] < k["start"] - k["n"]))
    picked = F.aggregate("spans", F.array().cast(SPAN), lambda kept, s: F.when(clear(kept, s), F.array_append(kept, s)).otherwise(kept))
    found = runs.groupBy("id", "run").agg(spans.alias("spans")).select("id", F.explode(picked).alias("s")).select("id", "s.start", (-F.col("s.n")).alias("n"), "s.name")
    ids = names.select("name_id", F.array_join(_words(F.col("name")), " ").alias("name")).where("name <> ''").distinct()
    return found.join(ids, "name").select("id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), "name_id")
