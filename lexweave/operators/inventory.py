"""Exhaustive search: requests, terms, candidates, results and the state of the index."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import STOPWORDS
from lexweave.operators.retrieval import small_side

# Bounds of terms and of a request.
TERM_WORDS, TERM_CHARS, GENERATED = 6, 120, 48
SOURCES = ("circulars", "laws")


class InvalidRequest(ValueError):
    """A request that can't be answered."""


@dataclass
class Request:
    query: str
    alternates: list[str] = field(default_factory=list)
    sources: tuple[str, ...] = SOURCES
    band: int = 150
    candidates: int = 400
    results: int = 200
    evidence: int = 3

    def checked(self) -> Request:
        """The request itself; ``InvalidRequest`` says the first thing that is wrong."""
        wrong = [
            (not (self.query or "").strip(), "a query needs words"),
            (not self.sources, "a query needs a source"),
            (bool(set(self.sources) - set(SOURCES)), f"unknown sources: {sorted(set(self.sources) - set(SOURCES))}"),
            (self.band < 0, "the band is negative"),
            (self.candidates < 1, "candidates must be 1 at least"),
            (self.results < 1, "results must be 1 at least"),
            (not 1 <= self.evidence <= 5, "evidence must be 1 to 5 passages"),
        ]
        for bad, why in wrong:
            if bad:
                raise InvalidRequest(why)
        return self


def field_of_kind(answer: dict[str, Any], name: str, kind: type) -> Any | None:
    """A field by its name, or else the only one of its kind; None if that is no single one."""
    if isinstance(answer.get(name), kind):
        return answer[name]
    alike = [v for v in answer.values() if isinstance(v, kind)]
    return alike[0] if len(alike) == 1 else None


def list_field(answers: Column, name: str) -> Column:
    """``field_of_kind`` for lists of strings, over a column of JSON objects; null if there is no single one."""
    entries = F.map_entries(F.from_json(answers, "map<string,string>"))
    listed = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.from_json(e["value"], "array<string>").alias("value"))), lambda e: F.ltrim(F.call_function("get_json_object", answers, F.concat(F.lit("$."), e["key"]))).startswith("["))
    own = F.get(F.filter(listed, lambda e: e["key"] == name), F.lit(0))["value"]
    return F.coalesce(own, F.when(F.size(listed) == 1, F.get(listed, F.lit(0))["value"]))


def acceptable(term: Column) -> Column:
    """Whether a term can be searched for: not empty, not long, and with a word that is no stopword."""
    plain = F.trim(F.coalesce(term, F.lit("")))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    told = F.filter(F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    return (plain != "") & (F.length(plain) <= TERM_CHARS) & (F.size(words) <= TERM_WORDS) & (F.size(told) > 0)


def term_sets(queries: DataFrame, alternates: DataFrame, generated: DataFrame) -> DataFrame:
    """(query_id, term, origin): each query's own words, its caller's terms and generated ones, each once, case aside.

    Queries are (query_id, text), alternates and generated (query_id,
    position, text). What comes first keeps a term; at most ``GENERATED``
    generated terms count.
    """
    own = queries.where(F.trim("text") != "").select("query_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"), F.trim("text").alias("term"))
    more = [frame.where(acceptable(F.col("text"))).select("query_id", F.lit(p).alias("part"), F.col("position").cast("long").alias("position"), F.trim("text").alias("term")) for p, frame in ((1, alternates), (2, generated))]
    from pyspark.sql import Window

    rows = own.unionByName(more[0]).unionByName(more[1])
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", F.lower("term")).orderBy("part", "position"))).where("_r = 1")
    counted = once.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "part").orderBy("position"))).where((F.col("part") < 2) | (F.col("_n") <= GENERATED))
    return counted.select("query_id", "term", F.get(F.array(F.lit("verbatim"), F.lit("caller"), F.lit("generated")), F.col("part")).alias("origin"))


def build_terms(query: str, alternates: list[str] | None = None, generate: Callable[[str], dict] | None = None) -> tuple[dict[str, list[str]], list[str]]:
    """The terms of one query by origin, and warnings; a generator that fails costs its terms alone."""
    told = lambda t: isinstance(t, str) and t.strip() and len(t.strip()) <= TERM_CHARS and len(t.split()) <= TERM_WORDS and any(len(w) > 1 and w not in STOPWORDS for w in re.findall(r"\w+", t.lower()))
    terms = {"verbatim": [query.strip()] if query.strip() else [], "caller": [t.strip() for t in alternates or [] if told(t)], "generated": []}
    if generate is None:
        return terms, []
    try:
        listed = field_of_kind(generate(query), "terms", list)
    except Exception as problem:  # noqa: BLE001  whatever a generator raises
        return terms, [f"no terms were generated ({problem}); only the query's own words are searched for"]
    seen = {t.lower() for part in terms.values() for t in part}
    for t in listed or []:
        if told(t) and t.strip().lower() not in seen and len(terms["generated"]) < GENERATED:
            seen.add(t.strip().lower())
            terms["generated"].append(t.strip())
    return terms, [] if terms["generated"] else ["no usable terms were generated; only the query's own words are searched for"]


def fingerprint_mismatch(recorded: DataFrame, current: str, width: int | None = None) -> DataFrame:
    """(fingerprint, width): recorded models of an index that can't be compared with the current one; no rows if it can.

    An index of which any part has the current fingerprint is current; a part of
    another width never is comparable.
    """
    marked = recorded.select("fingerprint", "width").distinct().withColumn("same", F.col("fingerprint") == current)
    some = marked.agg(F.max("same").alias("some"))  # one row
    wrong = (~F.col("some")) | ((F.col("width") != width) if width is not None else F.lit(False))
    return marked.crossJoin(F.broadcast(some)).where(wrong).select("fingerprint", "width")


def results(candidates: DataFrame, chunks: DataFrame, records: DataFrame, evidence: int, spans: DataFrame | None = None) -> DataFrame:
    """(key, kind, title, …, evidence, unverified): included candidates with their best passages.

    Candidates are (key, kind, lexical, score, reason, chunk_ids best first),
    chunks (chunk_id, source_id, label, text, page, offset), records (key,
    title, …), spans (chunk_id, span, verified). A span that is not verified
    gives way to its whole passage. Ordered lists come first by ``position``.
    """
    plan = candidates.select("key", F.posexplode_outer(F.slice("chunk_ids", 1, evidence)).alias("n", "chunk_id"))
    met = plan.join(small_side(chunks, 100_000), "chunk_id", "left")
    if spans is None:
        met = met.withColumn("span", F.lit(None).cast("string")).withColumn("verified", F.lit(False))
    else:
        met = met.join(spans, "chunk_id", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page").cast("string"))).when(F.col("offset").isNotNull(), F.concat(F.lit("offset "), F.col("offset").cast("string"))).otherwise(F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")))
    item = F.struct("n", "source_id", "label", F.when(F.col("verified"), F.col("span")).otherwise(F.col("text")).alias("text"), "verified", where.alias("locator"))
    shown = met.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), item))).alias("evidence"), F.count_if(F.col("text").isNotNull() & ~F.col("verified")).alias("unverified"))
    return candidates.drop("chunk_ids").join(records, "key").join(shown, "key", "left")


def result_order(frame: DataFrame) -> DataFrame:
    """Results found by words first, then by score, kind and key."""
    return frame.orderBy(F.desc("lexical"), F.desc("score"), F.asc("kind"), F.asc("key"))


def evidence_rows(found: DataFrame) -> DataFrame:
    """A row for each passage of each result, or one without a passage: the sheet of an export."""
    return found.select("key", "kind", "title", F.explode_outer("evidence").alias("e")).select("key", "kind", "title", "e.n", "e.label", "e.text", "e.verified", "e.locator")


def index_status(sources: DataFrame, ledger: DataFrame, snapshot: str | None = None) -> DataFrame:
    """(status, sources, chunks): expected sources against the ledger, by status, with those out of scope and unsearchable.

    Sources are (id, expected, excluded, unsearchable), the ledger (id, stored).
    """
    joined = sources.join(ledger, "id", "full_outer")
    status = (
        F.when(F.col("excluded").isNotNull(), F.concat(F.lit("excluded: "), "excluded"))
        .when(F.col("unsearchable").isNotNull(), F.concat(F.lit("unsearchable: "), "unsearchable"))
        .when(F.col("expected").isNull(), "orphan").when(F.col("expected") == 0, "empty").when(F.col("stored").isNull(), "missing")
        .when(F.col("expected") == F.col("stored"), "indexed").otherwise("stale")
    )
    found = joined.groupBy(status.alias("status")).agg(F.count("*").alias("sources"), F.coalesce(F.sum("stored"), F.lit(0)).cast("long").alias("chunks"))
    return found if snapshot is None else found.withColumn("snapshot", F.lit(snapshot))
