"""Corpus operators: scope, ledger, links, versions, synonyms, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators.retrieval import small_side
from lexweave.operators.subsets import containing, key_of
from lexweave.session import settled


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    found = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        found = F.when(rule, F.lit(name)).otherwise(found)
    return found


def scope(sources: DataFrame, excluded: dict[str, Column], unsearchable: dict[str, Column]) -> DataFrame:
    """Sources with the reason they are out of scope by design, or in scope but not searchable."""
    return sources.withColumn("excluded", first_reason(excluded)).withColumn("unsearchable", F.when(F.col("excluded").isNull(), first_reason(unsearchable)))


def reconcile(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, expected, stored, status) of a full outer join: empty, indexed, stale, missing or orphan."""
    joined = expected.join(stored, "id", "full_outer")
    status = F.when(F.col("expected").isNull(), "orphan").when(F.col("expected") == 0, "empty").when(F.col("stored").isNull(), "missing").when(F.col("expected") == F.col("stored"), "indexed").otherwise("stale")
    return joined.select("id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored"), status.alias("status"))


#: Names that go to every task by broadcast; more meet the texts by a shuffle.
BROADCAST_NAMES = 200_000
ANCHOR_WORDS = 3


def contained_names(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name_id): documents whose canonical text has a name's canonical words in a row, whatever their number.

    Runs of up to ``ANCHOR_WORDS`` words meet the names that begin with them by
    an equi join on a hash, before any shuffle where the names are few; the
    whole name is then looked for in the documents that are left.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    listed = docs.select("doc_id", words.alias("w"))
    asked = names.select("name_id", F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0)).alias("want")).where(F.size("want") > 0)
    asked = asked.withColumn("n", F.least(F.size("want"), F.lit(ANCHOR_WORDS)))
    widths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # at most ANCHOR_WORDS rows
    if not widths:
        return docs.select("doc_id").limit(0).crossJoin(names.select("name_id"))
    key = lambda array, i, n: F.xxhash64(F.lit(n), *[F.get(array, i + j) for j in range(n)])
    own = F.lit(None).cast("long")
    for n in widths:
        own = F.when(F.col("n") == n, key(F.col("want"), F.lit(0), n)).otherwise(own)
    asked = small_side(asked.select("name_id", "want", own.alias("key")), BROADCAST_NAMES)
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: key(F.col("w"), i, n))).otherwise(F.array().cast("array<bigint>"))
    runs = [run(n) for n in widths]
    met = settled(listed.select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("key")).join(asked, "key").select("doc_id", "name_id", F.array_join("want", " ").alias("name")).distinct())
    texts = listed.select("doc_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("canonical"))
    whole = texts.join(small_side(met.select("doc_id").distinct(), BROADCAST_NAMES), "doc_id", "left_semi")
    return met.join(whole, "doc_id").where(F.contains("canonical", F.concat(F.lit(" "), F.col("name"), F.lit(" ")))).select("doc_id", "name_id").distinct()


def near(mentions: DataFrame, parts: DataFrame, reach: int = 200) -> DataFrame:
    """Pairs of one document whose places lie within ``reach``: a band join on buckets of that width."""
    a = mentions.select("doc_id", F.col("at").alias("at_a"), F.explode(F.array(*[F.floor(F.col("at") / reach) + i for i in (-1, 0, 1)])).alias("band"))
    b = parts.select("doc_id", F.col("at").alias("at_b"), F.floor(F.col("at") / reach).alias("band"))
    return a.join(b, ["doc_id", "band"]).where(F.abs(F.col("at_a") - F.col("at_b")) <= reach).select("doc_id", "at_a", "at_b").distinct()


def _worded(titles: DataFrame, subjects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Titles and subjects with the keys of their words, and each key's least id, first or last day and words."""
    t = settled(titles.select("id", "day", F.array_distinct(X.tokens(F.col("title"))).alias("words")).where("words is not null").withColumn("key", key_of(F.col("words"))))
    s = settled(subjects.select("subject_id", "before", F.array_distinct(X.tokens(F.col("subject"))).alias("want")).where(F.size("want") > 0).withColumn("want_key", key_of(F.col("want"))))
    sets = settled(t.groupBy("key").agg(F.min("id").alias("title_class"), F.min("day").alias("first_day"), F.first("words").alias("words")))
    wants = settled(s.groupBy("want_key").agg(F.min("subject_id").alias("subject_class"), F.max("before").alias("last"), F.first("want").alias("want")))
    return t, s, sets, wants


def subset_titles(titles: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, id): earlier titles that have every word of a subject; copies give as many rows as they have pairs."""
    t, s, sets, wants = _worded(titles, subjects)
    met = containing(wants, sets).join(s.select("want_key", "subject_id", "before"), "want_key").join(t.select("key", "id", "day"), "key")
    return met.where(F.col("day") < F.col("before")).select("subject_id", "id")


def subset_classes(titles: DataFrame, subjects: DataFrame) -> DataFrame:
    """(part, id, class_id): the same by classes, so that copies cost a row each.

    Rows "title" and "subject" say which class an id is of, the least id with the same
    words; rows "pair" (class of a subject, class of titles that have its words), that an earlier
    title of the second goes with a subject of the first. A title goes with a subject
    if it is earlier and their classes are a pair.
    """
    t, s, sets, wants = _worded(titles, subjects)
    row = lambda part, i, c: [F.lit(part).alias("part"), F.col(i).alias("id"), F.col(c).alias("class_id")]
    members = t.join(sets.select("key", "title_class"), "key").select(*row("title", "id", "title_class")).unionByName(s.join(wants.select("want_key", "subject_class"), "want_key").select(*row("subject", "subject_id", "subject_class")))
    met = containing(wants, sets).join(wants.select("want_key", "subject_class", "last"), "want_key").join(sets.select("key", "title_class", "first_day"), "key")
    return members.unionByName(met.where(F.col("first_day") < F.col("last")).select(*row("pair", "subject_class", "title_class")))


def expand_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query, term, own): a query's terms and the tokens of their synonyms, each once."""
    more = terms.join(synonyms, "term").select("query", F.explode(X.tokens(F.col("phrase"))).alias("term"), F.lit(False).alias("own"))
    return terms.select("query", "term", F.lit(True).alias("own")).unionByName(more).groupBy("query", "term").agg(F.max("own").alias("own"))


def current_versions(versions: DataFrame, now: Column) -> DataFrame:
    """One version of each document in force, among those of source "live" whose day has come.

    Rows are (document_id, version_id, source, effective_from, first_seen,
    listed, listed_day, listed_order). The latest effective day wins; where no
    version has one, the one that the listing names, of these the latest row
    by day and order, then the one seen last. Ties go to the smaller
    version_id. A document whose versions all lie ahead has none.
    """
    eligible = versions.where((F.col("source") == "live") & (F.col("effective_from").isNull() | (F.col("effective_from") <= now)))
    undated = F.col("effective_from").isNull()
    # A dated version goes before all undated ones; the rest only tells undated ones apart.
    order = [F.col("effective_from").desc_nulls_last()]
    order += [F.when(undated, c).desc_nulls_last() for c in (F.col("listed"), F.when(F.col("listed"), F.col("listed_day")), F.when(F.col("listed"), F.col("listed_order")), F.col("first_seen"))]
    best = Window.partitionBy("document_id").orderBy(*order, F.col("version_id"))
    return eligible.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def series_pairs(cells: DataFrame) -> DataFrame:
    """(table_id, day, rate): in each row of cells a date goes with the next rate; of equal dates the last counts."""
    row = Window.partitionBy("table_id", "row").orderBy("position")
    pending = cells.withColumn("pending", F.last("day", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1)))
    used = pending.withColumn("nth", F.count("rate").over(Window.partitionBy("table_id", "row", "pending").orderBy("position")))
    pairs = used.where("rate is not null and pending is not null and nth = 1")
    return pairs.groupBy("table_id", F.col("pending").alias("day")).agg(F.max_by("rate", F.struct("row", "position")).alias("rate"))


def allowed_url(url: Column, host: str) -> Column:
    """https addresses of the host or below it, without user names."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^https://([^/?#]*)", 1)
    return (found == host) | found.endswith("." + host)


REDACTED = "[redacted]"
SECRETS = r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\"?\s*[:=]\s*\"?)([^\s\",}]+)"


def redact(text: Column) -> Column:
    """Values of secret-looking keys taken out."""
    return F.regexp_replace(F.regexp_replace(text, SECRETS, "$1$2" + REDACTED), r"(?i)\bbearer\s+[A-Za-z0-9._-]+", "Bearer " + REDACTED)


def number(text: Column) -> Column:
    """A number from text with thousands separators; null if it is none."""
    return F.regexp_replace(F.trim(text), r"[, ]", "").try_cast("double")


def day(text: Column) -> Column:
    """A date in one of the known forms; null if it is none."""
    forms = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d-MMM-yyyy")
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in forms], F.try_to_date(F.left(F.trim(text), F.lit(10)), "yyyy-MM-dd"))
