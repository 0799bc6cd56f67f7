"""Context for a conversation over chosen circulars: whole documents within a budget, then passages, citations and transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import references as REF
from lexweave.functions import text as X
from lexweave.operators import retrieval as R
from lexweave.operators.batches import StopMark
from lexweave.operators.folds import greedy_budget


def manifest(circulars: DataFrame, attachments: DataFrame) -> DataFrame:
    """(id, manifest): what a circular is and which attachments it has, as lines.

    Circulars are (id, label, title, department, day, url), attachments (owner,
    attachment_id, filename, file_type, url, status, has_text, indexed).
    """
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    say = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    line = F.concat(F.lit("- [[attachment:"), F.col("attachment_id").cast("string"), F.lit("|"), "filename", F.lit("]]; type="), say("file_type", "unknown"), F.lit("; source_url="), say("url", "Unavailable"), F.lit("; extraction_status="), say("status", "unknown"), F.lit("; text_available="), yes("has_text"), F.lit("; indexed="), yes("indexed"))
    lines = attachments.groupBy(F.col("owner").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.lower("filename").alias("name"), "attachment_id", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = [F.concat(F.lit("Circular: [[circular:"), F.col("id").cast("string"), F.lit("|"), "label", F.lit("]]")), F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Department: "), say("department", "Unknown")), F.concat(F.lit("Date: "), say("day", "Unknown")), F.concat(F.lit("Source URL: "), say("url", "Unavailable")), F.lit("Attachments:")]
    found = circulars.join(lines, "id", "left")
    return found.select("id", F.array_join(F.concat(F.array(*head), F.coalesce("lines", F.array(F.lit("- None")))), "\n").alias("manifest"))


def direct_documents(chosen: DataFrame, budget: int) -> DataFrame:
    """Documents of a session (session, position, …, text) that go in whole: in order, each that still fits."""
    return greedy_budget(chosen.withColumn("tokens", X.token_estimate(F.col("text"))), "session", "position", "tokens", budget)


def scoped_passages(chunks: DataFrame, queries: DataFrame, semantic: DataFrame | None, limit: int = 5) -> DataFrame:
    """(query_id, id, score, rank): chunks of the chosen documents by the fused ranks of both arms.

    Chunks are (id, text), queries (query_id, text); reference labels, which add
    nothing inside chosen documents, leave the query first. A chunk without
    any word of the query has no lexical rank, but counts in the ranking of others.
    """
    focused = queries.select("query_id", REF.focused_query(F.col("text")).alias("text"))
    lexical = R.okapi(chunks, R.query_terms(focused, "query_id", "text"), "query_id", "id", 2**31 - 1)
    arms = {"lexical": lexical} if semantic is None else {"lexical": lexical, "semantic": semantic}
    return R.top_k(R.rrf(arms, ["query_id", "id"]), max(1, min(limit, 10)), ["query_id"], [F.desc("score"), F.asc("id")])


def within_budget(passages: DataFrame, budget: int, terms: list[str]) -> DataFrame:
    """Passages (query_id, rank, text, …) in order until the budget is used; the one that exceeds it is cut to what is left."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = passages.withColumn("tokens", X.token_estimate(F.col("text"))).withColumn("left", F.lit(budget) - before).where("left > 0")
    cut = X.excerpt_within(F.col("text"), terms, F.col("left") * 4)
    return rows.withColumn("text", F.when(F.col("tokens") > F.col("left"), cut).otherwise(F.col("text"))).drop("tokens", "left")


def context(manifests: DataFrame, direct: DataFrame, passages: DataFrame) -> DataFrame:
    """(session, context): manifest, whole documents and passages of each session under their headings.

    Manifests are (session, position, manifest), direct and passages (session, position, citation, text).
    """
    joined = lambda frame, item, name: frame.groupBy("session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"]), "\n\n").alias(name))
    body = lambda head: F.concat(F.lit("Source: "), "citation", F.lit(f"\n{head}:\n"), "text")
    found = joined(manifests, F.col("manifest"), "m").join(joined(direct, body("Full extracted text"), "d"), "session", "left").join(joined(passages, body("Passage"), "p"), "session", "left")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.array(F.lit(head), F.col(c))).otherwise(F.array().cast("array<string>"))
    return found.select("session", F.array_join(F.concat(part("Selected circular and attachment manifest:", "m"), part("Small documents included in full:", "d"), part("Automatically retrieved passages for this question:", "p")), "\n\n").alias("context"))


# Signs of what went wrong with a provider, by what its answer says; the first state that holds counts.
STATES = (
    ("rate_limited", (413, 429), ("rate_limit", "rate limit", "too many requests", "tokens per minute", "requests per minute", "quota")),
    ("auth_error", (401, 403), ("invalid api key", "incorrect api key", "authentication", "unauthorized", "permission")),
    ("not_found", (404,), ("model not found", "model_not_found", "no such model")),
    ("offline", (), ("connection error", "connection refused", "timed out", "timeout", "failed to establish", "name resolution", "max retries")),
    ("server_error", (), ("internal server error", "service unavailable", "bad gateway", "overloaded")),
)


def provider_state(status: Column, message: Column) -> Column:
    """What an error of a provider means: one of ``STATES``, or "error"."""
    text = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit("error")
    for name, codes, signs in reversed(STATES):
        test = F.exists(F.array(*[F.lit(s) for s in signs]), lambda s: F.contains(text, s))
        if codes:
            test = test | F.coalesce(status.isin(*codes), F.lit(False))
        if name == "server_error":
            test = test | F.coalesce(status >= 500, F.lit(False))
        found = F.when(test, F.lit(name)).otherwise(found)
    return found


def batch_calls(rows: DataFrame, call: Callable[[dict], str], skip: Column | None = None, stop: StopMark | None = None) -> DataFrame:
    """``rows`` with ``output`` and ``error`` of a call for each; skipped rows have neither.

    A call that fails costs its row alone. After an error that tells of a limit
    a task makes no further calls: its other rows have the error "stopped". With
    a ``stop`` mark the other tasks see it before their next call and stop too.
    """
    asked = rows.withColumn("_skip", F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False))
    schema = rows.schema.add("output", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stopped = False
        limits = STATES[0][2]
        for batch in batches:
            outputs, errors = [], []
            for row in batch.to_pylist():
                output = error = None
                if not row.pop("_skip"):
                    stopped = stopped or (stop is not None and stop.is_set())
                    if stopped:
                        error = "stopped"
                    else:
                        try:
                            output = call(row)
                        except Exception as problem:  # noqa: BLE001  what a provider raises is data here
                            error = str(problem) or type(problem).__name__
                            stopped = any(s in error.lower() for s in limits)
                            if stopped and stop is not None:
                                stop.set()
                outputs.append(output)
                errors.append(error)
            kept = batch.drop_columns(["_skip"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(outputs, pa.string()), pa.array(errors, pa.string())], [*kept.schema.names, "output", "error"])

    return asked.mapInArrow(run, schema)


def sessions_for(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(request_id, session_id, created): each request's session if it is its user's own, else a new one named by the request.

    Requests are (request_id, session_id, user_id), sessions (session_id, user_id).
    """
    own = sessions.select("session_id", "user_id", F.lit(True).alias("own"))
    found = requests.join(own, ["session_id", "user_id"], "left")
    made = F.concat(F.lit("s-"), F.col("request_id").cast("string"))
    return found.select("request_id", F.when(F.col("own"), F.col("session_id")).otherwise(made).alias("session_id"), F.col("own").isNull().alias("created"))


def unresolved_citations(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, n_citations, unresolved): citations ``[[kind:id|label]]`` of each answer, and how many name nothing that is known.

    Answers are (answer_id, text), known (kind, id as text).
    """
    marks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[\[((?:circular|attachment|law):[^\]|\n]*)(?:\|[^\]\n]*)?\]\]"), F.lit(1))
    cited = answers.select("answer_id", F.explode_outer(marks).alias("key"))
    have = R.small_side(known.select(F.concat_ws(":", "kind", "id").alias("key"), F.lit(True).alias("have")).distinct(), R.BROADCAST_TERMS)
    return cited.join(have, "key", "left").groupBy("answer_id").agg(F.count("key").alias("n_citations"), F.count_if(F.col("key").isNotNull() & F.col("have").isNull()).alias("unresolved"))


def events_of(parts: DataFrame) -> DataFrame:
    """(session, position, event, data): a stream of parts as events: meta, tokens, then done or error.

    Parts are (session, position, text, error). A part of blanks is none; after an error nothing follows.
    """
    from pyspark.sql import Window

    seen = F.max(F.when(F.col("error").isNotNull(), F.col("position"))).over(Window.partitionBy("session").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    live = parts.withColumn("_seen", seen).where("_seen is null and (error is not null or length(text) > 0)")
    body = live.select("session", F.col("position").cast("long").alias("position"), F.when(F.col("error").isNotNull(), "error").otherwise("token").alias("event"), F.coalesce("error", "text").alias("data"))
    ends = parts.groupBy("session").agg(F.max("position").alias("last"), F.count("error").alias("errors"))
    meta = ends.select("session", F.lit(-1).cast("long").alias("position"), F.lit("meta").alias("event"), F.col("session").cast("string").alias("data"))
    done = ends.where("errors = 0").select("session", (F.col("last") + 1).cast("long").alias("position"), F.lit("done").alias("event"), F.lit("").alias("data"))
    return meta.unionByName(body).unionByName(done)


def sse(event: Column, data: Column) -> Column:
    """An event as its lines on the wire; data of several lines has a field for each."""
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n\n"))


def adjudication_batches(candidates: DataFrame, size: int = 12) -> pd.DataFrame:
    """How many batches of ``size`` a set of candidates makes: one row."""
    return candidates.agg(F.count("*").alias("n")).select("n", F.ceil(F.col("n") / size).alias("batches")).toPandas()
