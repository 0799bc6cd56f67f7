"""Supersessions that no edge names: lists in annexures, and "all previous instructions on the subject".

Rules add edges in order, explicit edges first; each leaves out what those before it
have put in, and every edge tells its rule. No rule reads another's edges for
anything else, so one pass is complete. ``all_edges`` and ``all_statuses`` apply all that
matches. ``supersessions`` is for edges that are applied unseen: what matches
implausibly much is put up for review and adds nothing there.

Documents without a day, flags without a subject and ends that are not there add nothing;
repeated rows count once; ties are broken by the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as X
from lexweave.operators import graph
from lexweave.operators.subsets import WORD_SETS, containing, key_of, running_sum
from lexweave.session import settled

# Confidence of derived edges; references of an annexure, matching titles and confirmed titles beyond which a person decides; candidates that are shown for confirmation.
CONFIDENCE = 0.9
MAX_LISTED, MAX_MATCHES, MAX_CONFIRMED, SHORTLIST = 150, 80, 60, 40
#: Titles of one word that a task takes; equal titles of a part, which meet each subject that they hold.
WORD_TITLES, PART_TITLES = WORD_SETS, 1_000
EDGE = ["source_id", "target_id", "kind", "confidence", "rule"]


def stems(text: Column) -> Column:
    """Distinct tokens; those over three characters lose an "s" at the end."""
    return F.array_distinct(F.transform(X.tokens(F.coalesce(text, F.lit(""))), lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w)))


def _asked(nodes: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Titles (target_id, day, words, key), subjects (source_id, before, want, own, want_key), and which keys of titles hold which subjects (want_key, key)."""
    said = flags.where(F.trim("subject") != "").groupBy("source_id").agg(F.min("subject").alias("subject"))
    dated = nodes.where(F.col("id").isNotNull() & F.col("day").isNotNull()).dropDuplicates(["id"])
    titles = settled(dated.select(F.col("id").alias("target_id"), "day", stems(F.col("title")).alias("words")).withColumn("key", key_of(F.col("words"))))
    known = said.join(titles, F.col("source_id") == F.col("target_id")).select("source_id", F.col("day").alias("before"), stems(F.col("subject")).alias("want"), F.col("words").alias("own"))
    known = known.withColumn("want", F.when(F.size("want") > 0, F.col("want")).otherwise(F.col("own"))).where(F.size("want") > 0)
    asked = settled(known.withColumn("want_key", key_of(F.col("want"))))
    # Equal subjects, and equal titles, meet once.
    one = lambda frame, key, words: settled(frame.groupBy(key).agg(F.first(words).alias(words)))
    return titles, asked, containing(one(asked, "want_key", "want"), one(titles, "key", "words"), WORD_TITLES)


def every(nodes: DataFrame, flags: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id): all earlier documents whose titles hold a flagged document's subject, however many; pairs in ``known`` are left out.

    Titles of a key are dealt to parts, and each subject that the key holds goes to each of
    them; a task meets a part's titles at a time, and pairs are never shuffled.
    """
    titles, asked, met = _asked(nodes, flags)
    parts = settled(titles.groupBy("key").agg(F.ceil(F.count("*") / PART_TITLES).cast("int").alias("parts")))
    dealt = titles.select("target_id", "day", "key").join(parts, "key").withColumn("part", F.pmod(F.hash("target_id"), F.col("parts"))).drop("parts")
    want = asked.select("source_id", "before", "want_key").join(met.join(parts, "key"), "want_key").drop("want_key")
    want = want.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = settled(dealt)
    clear = F.col("day") < F.col("before")
    if known is not None:
        # What a source has of a part already, which is no more than the part.
        has = known.join(dealt, "target_id").groupBy("source_id", "key", "part").agg(F.collect_set("target_id").alias("has"))
        want = want.join(has, ["source_id", "key", "part"], "left")
        clear &= F.col("has").isNull() | ~F.array_contains("has", F.col("target_id"))
    # As many tasks as a shuffle has, whatever its bytes: what comes out is far more than what goes in.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return want.repartition(tasks, "key", "part").join(dealt.repartition(tasks, "key", "part").hint("merge"), ["key", "part"]).where(clear).select("source_id", "target_id")


def blanketed(nodes: DataFrame, flags: DataFrame) -> DataFrame:
    """(target_id): the documents that ``every`` gives as targets, without a row for each pair: the latest document that asks for a title is enough."""
    titles, asked, met = _asked(nodes, flags)
    latest = met.join(asked.groupBy("want_key").agg(F.max("before").alias("before")), "want_key").groupBy("key").agg(F.max("before").alias("before"))
    return titles.join(latest, "key").where(F.col("day") < F.col("before")).select("target_id")


def blanket(nodes: DataFrame, flags: DataFrame, confirm: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """((source_id, target_id), (source_id, matches)): what each flagged document supersedes by itself, and what a person must decide.

    Nodes are (id, day, title), flags (source_id, subject). A subject without stems stands
    for its document's title. The ``SHORTLIST`` best titles go to ``confirm``, which
    gives those rows (source_id, target_id, score) back that it confirms; without one, all hold.
    ``every`` has no such limits.
    """
    titles, asked, met = _asked(nodes, flags)
    listed = settled(met.join(titles.select("key", "day", "target_id"), "key").drop("key"))
    days = listed.groupBy("want_key", "day").agg(F.count("*").alias("n"))
    asking = asked.select("want_key", F.col("before").alias("day"), F.lit(0).cast("long").alias("n")).distinct()
    line = settled(running_sum(days.unionByName(asking).groupBy("want_key", "day").agg(F.sum("n").alias("n")), "want_key", "day", "n", "through"))
    # Documents of the day itself are no earlier ones.
    earlier = line.select("want_key", F.col("day").alias("before"), (F.col("through") - F.col("n")).alias("matches")).where("matches > 0")
    counted = settled(asked.select("source_id", "want_key", "before").join(earlier, ["want_key", "before"]))
    # What matches so few has only these titles; no subject has more of them than the limit.
    first = listed.join(line.where((F.col("n") > 0) & (F.col("through") <= MAX_MATCHES)).select("want_key", "day"), ["want_key", "day"])
    pairs = counted.where(F.col("matches") <= MAX_MATCHES).join(first, "want_key").where(F.col("day") < F.col("before")).select("source_id", "target_id")
    met = pairs.join(asked.select("source_id", F.array_union("want", "own").alias("told")), "source_id").join(titles.select("target_id", "words"), "target_id").select("source_id", "target_id", F.size(F.array_intersect("words", "told")).alias("score"))
    best = met.withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))).where(F.col("_r") <= SHORTLIST).drop("_r")
    held = settled(confirm(best) if confirm else best).select("source_id", "target_id").distinct()
    many = held.groupBy("source_id").agg(F.count("*").alias("matches")).where(F.col("matches") > MAX_CONFIRMED)
    review = counted.where(F.col("matches") > MAX_MATCHES).select("source_id", "matches").unionByName(many)
    return held.join(many, "source_id", "left_anti"), review


def _named(explicit: DataFrame, listed: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(edges that are explicit or listed, (source_id, matches) of the lists over the limit, which add none)."""
    first = explicit.select("source_id", "target_id", "kind", "confidence", F.lit("explicit").alias("rule"))
    refs = listed.where("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id")
    refs = refs.select("source_id", "target_id", F.when(F.col("kind") == "cancels", F.col("kind")).otherwise("supersedes").alias("kind")).groupBy("source_id", "target_id").agg(F.min("kind").alias("kind"))
    long = refs.groupBy("source_id").agg(F.count("*").alias("matches")).where(F.col("matches") > limit if limit is not None else F.lit(False))
    refs = refs if limit is None else refs.join(long, "source_id", "left_anti")
    second = refs.join(first.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    return first.unionByName(second.select("*", F.lit(CONFIDENCE).alias("confidence"), F.lit("listed").alias("rule")).select(*EDGE)), long


def _with_blanket(known: DataFrame, pairs: DataFrame) -> DataFrame:
    return known.unionByName(pairs.select("*", F.lit("supersedes").alias("kind"), F.lit(CONFIDENCE).alias("confidence"), F.lit("blanket").alias("rule")).select(*EDGE))


def all_edges(nodes: DataFrame, explicit: DataFrame, listed: DataFrame, flags: DataFrame) -> DataFrame:
    """The edges of ``supersessions`` where everything that matches counts: no list and no subject is too broad, no title is left out."""
    known = settled(_named(explicit, listed, None)[0])
    return _with_blanket(known, every(nodes, flags, known.where("kind = 'supersedes'").select("source_id", "target_id")))


def all_statuses(nodes: DataFrame, explicit: DataFrame, listed: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, status): what ``all_edges`` make of the documents; the pairs of broad subjects are not made for it."""
    pairs = blanketed(nodes, flags).select(F.lit(None).cast(explicit.schema["source_id"].dataType).alias("source_id"), "target_id")
    return graph.status_rollup(nodes, _with_blanket(_named(explicit, listed, None)[0], pairs))


def supersessions(nodes: DataFrame, explicit: DataFrame, listed: DataFrame, flags: DataFrame, confirm: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with their rule, (source_id, rule, matches) for review).

    ``explicit`` are (source_id, target_id, kind, confidence), ``listed`` the references of
    annexures, resolved: (source_id, target_id, kind), where another kind than
    "cancels" supersedes. A listed target that its source has any edge to stays as it is, a
    blanket one if it is superseded already. What is too broad to be applied unseen adds
    nothing and is put up for review; ``all_edges`` has the whole.
    """
    known, long = _named(explicit, listed, MAX_LISTED)
    held, broad = blanket(nodes, flags, confirm)
    third = held.join(known.where("kind = 'supersedes'").select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    edges = _with_blanket(known, third)
    review = long.select("source_id", F.lit("listed").alias("rule"), "matches").unionByName(broad.select("source_id", F.lit("blanket").alias("rule"), "matches"))
    return edges, review
