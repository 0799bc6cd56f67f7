"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions alone.

Two lines are near-duplicates if one edit at most (a character inserted,
deleted or replaced) lies between them, after blanks at both ends are cut.
A line goes if an earlier line, in the order of (doc_id, line number), is a
near-duplicate of it; lines under ``MIN_CHARS`` characters always stay.

1. Equal lines meet by a 128-bit hash; the earliest stands for all.
2. A line that has a near-duplicate agrees with it outside one of three
   segments. Lines that share no such key with another line drop out here.
3. The others emit their deletion neighbourhood as hashed keys: each variant
   with one character less, with its place (two lines that meet differ by one
   replacement) and without (they meet the line that equals the variant). Long
   lines are cut into leaves, so a line of n characters costs n * LEAF.
4. Lines with equal variants meet; of each meeting only the earliest matters,
   so no pairs within a group are made. The edit distance is then verified.

Edge cases: a null text stays null, an empty one empty; a document whose lines
all go keeps its row with an empty text; a null doc_id counts as the latest;
rows with equal doc_id and text are one document, whose copies get equal texts;
ties, lines of two rows with one doc_id and line number, go by neither: both
stay unless an earlier one exists; a text of any length is cut into its lines;
no rows give no rows; columns beside ``doc_id`` and ``text`` pass through, also
those with the operator's own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import free, written

MIN_CHARS = 10
SEGMENTS = 3
LEAF = 128
#: Lines that are broadcast by their keys, at some 40 bytes each; more of them meet the others by a shuffle.
BROADCAST_LINES = 300_000
LAST = 2**63 - 1


def _left(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), n)


def _from(text: Column, start: Column) -> Column:
    """The rest of ``text`` from the 1-based ``start``."""
    return F.substring(text, start, F.lit(2**31 - 1))


BLANKS = (" ", "\t", "\r")


def trimmed(text: Column) -> Column:
    """The text without blanks at its ends; most texts have none there and are not looked through."""
    blank = F.lit(False)
    for c in BLANKS:
        blank = blank | text.startswith(c) | text.endswith(c)
    return F.when(blank, F.btrim(text, F.lit("".join(BLANKS)))).otherwise(text)


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each line with its document's key, its place, its trimmed text and its hash."""
    split = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    line = split.withColumn("line", trimmed(F.col("raw"))).drop("raw")
    return line.where(F.length("line") >= min_chars).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(17), "line"))


KEYS = [f"k{i}" for i in range(2 * SEGMENTS)]


def segment_keys(line: Column) -> Column:
    """Hashes of the line without each segment, by its own length and by one less, as an array.

    Segments before the one that is left out are counted from the start, those
    after it from the end; each is hashed once, and a key is a hash of hashes.
    """
    n = F.length(line)
    keys = []
    for less in (0, 1):
        role = n - less
        edges = [F.floor(role * s / SEGMENTS).cast("int") for s in range(SEGMENTS + 1)]
        piece = lambda s, shift, edges=edges: F.xxhash64(F.substring(line, edges[s] + 1 + shift, edges[s + 1] - edges[s]))
        left = [piece(s, 0) for s in range(SEGMENTS)]
        # Counted from the end, a line of one character more has its segments one place further on.
        right = [piece(s, 1) for s in range(SEGMENTS)] if less else left
        keys += [F.xxhash64(role, F.lit(s), *left[:s], *right[s + 1 :]) for s in range(SEGMENTS)]
    return F.array(*keys)


def variants(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each row of (h1, h2, at, line) as keys.

    ``own`` marks the key of the line itself, by which it meets longer lines.
    """
    n, j = F.length("line"), F.col("leaf_no")
    leaf = F.substring(F.col("line"), j * LEAF + 1, F.lit(LEAF))
    cut = lines.withColumn("n", n).withColumn("leaf_no", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / LEAF).cast("int"))))
    cut = cut.withColumn("leaf", leaf).withColumn("around", F.xxhash64(_left(F.col("line"), j * LEAF), _from(F.col("line"), (j + 1) * LEAF + 1)))
    fewer = cut.select("h1", "h2", "at", "n", "leaf_no", "leaf", "around", F.explode(F.sequence(F.lit(1), F.length("leaf"))).alias("i"))
    variant = F.concat(_left(F.col("leaf"), F.col("i") - 1), _from(F.col("leaf"), F.col("i") + 1))
    placed = F.xxhash64(F.lit("placed"), "n", "leaf_no", "i", "around", variant)
    bare = F.xxhash64(F.lit("bare"), F.col("n") - 1, "leaf_no", "around", variant)
    shorter = fewer.select("h1", "h2", "at", F.explode(F.array(F.struct(placed.alias("key"), F.lit(None).cast("boolean").alias("own")), F.struct(bare.alias("key"), F.lit(False).alias("own")))).alias("v"))
    role = n + 1
    itself = lines.withColumn("n", n).withColumn("leaf_no", F.explode(F.sequence(F.lit(0), F.floor((role - 1) / LEAF).cast("int"))))
    width = F.least((j + 1) * LEAF, F.col("n") + 1) - j * LEAF - 1
    around = F.xxhash64(_left(F.col("line"), j * LEAF), _from(F.col("line"), (j + 1) * LEAF))
    key = F.xxhash64(F.lit("bare"), "n", "leaf_no", around, F.substring(F.col("line"), j * LEAF + 1, width))
    longer = itself.select("h1", "h2", "at", key.alias("key"), F.lit(True).alias("own"))
    return shorter.select("h1", "h2", "at", "v.key", "v.own").unionByName(longer)


def near_lines(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier near-duplicate."""
    spark = lines.sparkSession
    keyed = distinct.select("h1", F.explode(F.array(*KEYS)).alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    alive = written(keyed.join(met, "key", "left_semi").select("h1").distinct(), "alive")
    few = alive.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    texts = lines.select("doc", "th", "line_no", "h1", "h2", "line").join(F.broadcast(alive) if few else alive, "h1", "left_semi")
    texts = written(texts.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line_no")).alias("at"), F.first("line").alias("line")), "near-texts")
    own, other, placed = F.col("own"), ~F.col("own"), F.col("own").isNull()
    by_key = Window.partitionBy("key")
    who = F.struct("at", "h1", "h2")
    meetings = variants(texts).withColumn("first_own", F.min(F.when(own, who)).over(by_key)).withColumn("first_other", F.min(F.when(other, who)).over(by_key)).withColumn("first_placed", F.min(F.when(placed, who)).over(by_key))
    partner = F.when(own, F.col("first_other")).when(other, F.col("first_own")).otherwise(F.col("first_placed"))
    linked = meetings.withColumn("partner", partner).where(F.col("partner.at") < F.col("at")).groupBy("h1", "h2").agg(F.min("partner").alias("partner"))
    left = linked.join(texts.select("h1", "h2", "line"), ["h1", "h2"]).select("h1", "h2", "line", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2"))
    right = texts.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("earlier"))
    return left.join(right, ["p1", "p2"]).where(F.levenshtein("line", "earlier", 1) >= 0).select("h1", "h2")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, th, gone): the numbers of the lines that go, for each document with such lines."""
    lines = lines_of(docs, min_chars)
    at = F.struct("doc", "line_no")
    # Keys are made in a projection of their own, in compiled code; inside the aggregation they would be interpreted.
    keyed = lines.withColumn("keys", segment_keys(F.col("line"))).select(at.alias("at"), "h1", "h2", *[F.col("keys")[i].alias(k) for i, k in enumerate(KEYS)])
    distinct = written(keyed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("copies"), *[F.first(k).alias(k) for k in KEYS]), "lines")
    near = near_lines(lines, distinct)
    fate = written(distinct.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("near or copies > 1").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near")), "fate")
    few = fate.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    gone = lines.select("doc", "th", "line_no", "h1", "h2").join(F.broadcast(fate) if few else fate, ["h1", "h2"]).where(F.col("near") | (F.struct("doc", "line_no") > F.col("at")))
    return gone.groupBy("doc", "th").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, count: str | None = None) -> DataFrame:
    """``docs`` with the lines of ``text`` that have no earlier near-duplicate.

    With ``count``, a column of that name, or of the first free one with an
    underscore more, has the number of lines taken away.
    """
    gone = dropped_lines(docs, min_chars)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"))
    joined = keyed.join(gone, ["doc", "th"], "left")
    # The lines are a column of their own, so that a text is split once, not once a line.
    cut = joined.withColumn("parts", F.when(F.col("gone").isNotNull(), F.split("row.text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("parts"), i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).alias(free(count, docs.columns)))
    return cut.select(*columns)
