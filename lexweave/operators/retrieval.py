"""Ranked retrieval: postings, BM25, phrases, cosine, fusion and evidence.

Queries come as a DataFrame, so a batch of them costs one pass over the corpus.
Texts are tokenized once; what no query asks for goes before the first shuffle.
Each query's best are kept by a ranked window whose limit Spark also applies
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.session import settled

#: Query terms (some 50 bytes each) that go to every task by broadcast; more meet the postings by a shuffle.
BROADCAST_TERMS = 1_000_000


def top_k(frame: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    return frame.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def small_side(frame: DataFrame, bound: int) -> DataFrame:
    """``frame`` with a hint to broadcast it where it has at most ``bound`` rows."""
    return F.broadcast(frame) if frame.limit(bound + 1).count() <= bound else frame


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf, length): a row for each document and term."""
    rows = docs.select(F.col(doc), X.tokens(F.col(text)).alias("tokens"))
    rows = rows.select(doc, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return rows.groupBy(doc, "term").agg(F.count("*").cast("double").alias("tf"), F.first("length").alias("length"))


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term, qtf): the terms of each query as a bag; a term repeated counts again."""
    rows = queries.select(query, F.explode(X.tokens(F.col(text))).alias("term"))
    return rows.groupBy(query, "term").agg(F.count("*").alias("qtf"))


def asked_postings(docs: DataFrame, terms: DataFrame, doc: str, columns: dict[str, float]) -> DataFrame:
    """(doc, length, term, tf) for the asked terms alone, and a row with a null term for every document.

    ``columns`` have weights: a term counts as often as its columns weigh, and
    the length is that of all columns. Terms that nobody asks for go before
    the shuffle; texts are tokenized once, as the result is a written table.
    """
    listed = docs.select(F.col(doc), *[X.tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])
    length = sum(F.size(f"t{i}") for i in range(len(columns)))
    weighted = lambda i, w: F.transform(F.col(f"t{i}"), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))
    parts = [weighted(i, w) for i, w in enumerate(columns.values())]
    mark = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("w")))
    rows = listed.select(doc, length.alias("length"), F.explode(F.concat(mark, *parts)).alias("p")).select(doc, "length", "p.term", "p.w")
    wanted = small_side(terms.select("term").distinct().withColumn("asked", F.lit(True)), BROADCAST_TERMS)
    kept = rows.join(wanted, "term", "left").where("asked or term is null")
    return settled(kept.groupBy(doc, "term").agg(F.first("length").alias("length"), F.sum("w").alias("tf")))


def scored(posts: DataFrame, terms: DataFrame, query: str, doc: str, k: int, k1: float, b: float, floor: str) -> DataFrame:
    """The ``k`` best documents of each query by BM25; ties go to the smaller document.

    ``floor`` says what a term gets that half of the documents or more have:
    "clamp" a very small weight, "mean" a quarter of the mean weight of all
    terms of ``posts``.
    """
    totals = posts.where("term is null").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))  # one row
    df = posts.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))
    raw = df.withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if floor == "clamp":
        weighted = raw.withColumn("idf", F.when(F.col("raw") <= 0, F.lit(1e-6)).otherwise(F.col("raw")))
    else:
        weighted = raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean_raw")))).withColumn("idf", F.when(F.col("raw") < 0, F.lit(0.25) * F.col("mean_raw")).otherwise(F.col("raw")))
    weights = terms.join(weighted.select("term", "idf", "mean_length"), "term").select(query, "term", (F.col("qtf") * F.col("idf")).alias("weight"), "mean_length")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    # Where the query's weights are broadcast, postings of a document stay together, and its partial sums are whole before the shuffle.
    together = posts.where("term is not null").repartition(doc)
    met = together.join(small_side(weights, BROADCAST_TERMS), "term")
    return top_k(met.groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score")), k, [query], [F.desc("score"), F.asc(doc)])


def bm25(docs: DataFrame, terms: DataFrame, query: str, doc: str, k: int, k1: float = 1.2, b: float = 0.75, columns: dict[str, float] | None = None) -> DataFrame:
    """The ``k`` best documents of each query, as a full-text index ranks them, by weighted columns."""
    return scored(asked_postings(docs, terms, doc, columns or {"text": 1.0}), terms, query, doc, k, k1, b, "clamp")


def okapi(docs: DataFrame, terms: DataFrame, query: str, doc: str, k: int, k1: float = 1.5, b: float = 0.75, text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query where common terms weigh a quarter of the mean of the vocabulary.

    The mean is of all terms of ``docs``, asked or not, so its document
    frequencies are counted over the whole vocabulary.
    """
    listed = settled(docs.select(F.col(doc), X.tokens(F.col(text)).alias("tokens")))
    n = F.count("*").alias("n")
    totals = listed.agg(n, F.avg(F.size("tokens")).alias("mean_length"))  # one row
    df = listed.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = settled(df.crossJoin(F.broadcast(totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_raw"))  # one row
    asked = terms.join(raw, "term").crossJoin(F.broadcast(mean))
    idf = F.when(F.col("raw") < 0, F.lit(0.25) * F.col("mean_raw")).otherwise(F.col("raw"))
    weights = asked.select(query, "term", (F.col("qtf") * idf).alias("weight"), "mean_length")
    wanted = small_side(terms.select("term").distinct(), BROADCAST_TERMS)
    posts = listed.select(doc, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy(doc, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    met = posts.join(small_side(weights, BROADCAST_TERMS), "term").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(met, k, [query], [F.desc("score"), F.asc(doc)])


ANCHOR = 3


def phrase_matches(docs: DataFrame, phrases: DataFrame, doc: str, phrase: str, text: str = "text") -> DataFrame:
    """(phrase, doc): documents with the phrase's tokens in a row; no cutoff.

    Places meet phrases by a hash of up to ``ANCHOR`` first tokens, before any
    shuffle where the phrases are few; whole phrases are then compared in the
    documents that are left.
    """
    tokens = docs.select(doc, X.tokens(F.col(text)).alias("tokens"))
    asked = phrases.select(phrase, X.tokens(F.col("phrase_text")).alias("want")).where(F.size("want") > 0).withColumn("n", F.least(F.size("want"), F.lit(ANCHOR)))
    widths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # at most ANCHOR rows
    if not widths:
        return asked.select(phrase).crossJoin(docs.select(doc).limit(0))
    key = lambda array, i, n: F.xxhash64(F.lit(n), *[F.get(array, i + j) for j in range(n)])
    own = F.lit(None).cast("long")
    for n in widths:
        own = F.when(F.col("n") == n, key(F.col("want"), F.lit(0), n)).otherwise(own)
    asked = asked.select(phrase, "want", own.alias("key"))
    runs = lambda n: F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(0), F.size("tokens") - n), lambda i: key(F.col("tokens"), i, n))).otherwise(F.array().cast("array<bigint>"))
    places = [runs(n) for n in widths]
    met = tokens.select(doc, F.explode(F.array_distinct(F.concat(*places))).alias("key")).join(small_side(asked, BROADCAST_TERMS).select(phrase, "want", "key"), "key").drop("key").distinct()
    met = settled(met)
    whole = tokens.join(small_side(met.select(doc).distinct(), BROADCAST_TERMS), doc, "left_semi")
    last = F.size("tokens") - F.size("want")
    run = F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (F.get(F.col("tokens"), i) == F.get(F.col("want"), F.lit(0))) & (F.slice(F.col("tokens"), i + 1, F.size("want")) == F.col("want")))
    return met.join(whole, doc).where((last >= 0) & run).select(phrase, doc).distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Inner product over lengths; 0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


#: Queries that go to every task by broadcast (a few hundred bytes each); a larger set is dealt over blocks.
BROADCAST_QUERIES = 2000
#: Vectors whose scores for all queries are held at once.
HELD_VECTORS = 4096
#: Scores are rounded to six places afterwards; what lies so near the last kept one may tie with it.
MARGIN = 2e-6


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of length one; zero, null and odd-sized vectors as zeros."""
    rows = column.to_pylist()
    width = width or max((len(r) for r in rows if r), default=1)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r is not None and len(r) == width:
            out[i] = r
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class _Best:
    """The ``k`` best of each query so far, with all that may tie with the last."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros((len(asked), 0))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = np.concatenate([self.scores, self.asked @ vectors.T], 1)
        ids = np.concatenate([self.ids, ids])
        if len(ids) > self.k:
            last = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            self.cut = scores >= last[:, None] - MARGIN
            keep = self.cut.any(0)
            ids, scores = ids[keep], scores[:, keep]
        self.ids, self.scores = ids, scores

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.ids)
        if n > self.k:
            last = np.partition(self.scores, n - self.k, axis=1)[:, n - self.k]
            q, v = np.nonzero(self.scores >= last[:, None] - MARGIN)
        else:
            q, v = np.nonzero(np.ones_like(self.scores, bool))
        return query_ids[q], self.ids[v], self.scores[q, v]


PAIRS = "query_id long, vec_id long, score double"


def nearest_pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each block of vectors and query the ``k`` of the largest cosine, and ties.

    Both sides are brought to length one once, then scored by matrix products.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "q")
    names = [f.split()[0] for f in PAIRS.split(", ")]
    if asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        table = asked.toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best = _Best(matrix, k)
            for batch in batches:
                for i in range(0, batch.num_rows, HELD_VECTORS):
                    part = batch.slice(i, HELD_VECTORS)
                    best.add(part.column(0).to_numpy(), _matrix(part.column(1), matrix.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows(ids)], names)

        return rows.mapInArrow(run, PAIRS)
    # Vectors are dealt to blocks, queries to groups, and every group meets every block once.
    blocks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = -(-asked.count() // BROADCAST_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("group", every(groups))
    right = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))

    def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(pa.array(q["q"]))
        best = _Best(matrix, k)
        for i in range(0, len(v), HELD_VECTORS):
            best.add(v["vec_id"].to_numpy()[i : i + HELD_VECTORS], _matrix(pa.array(v["embedding"].iloc[i : i + HELD_VECTORS]), matrix.shape[1]))
        return pd.DataFrame(dict(zip(names, best.rows(q["query_id"].to_numpy()), strict=True)))

    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(meet, PAIRS)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact: rows (query_id, q) against rows (vec_id, embedding); scores to six places, ties to the smaller vec_id."""
    pairs = nearest_pairs(vectors, queries, k).withColumn("score", F.round("score", 6))
    return top_k(pairs, k, ["query_id"], [F.desc("score"), F.asc("vec_id")])


def best_per_group(vectors: DataFrame, queries: DataFrame, group: str) -> DataFrame:
    """(query_id, group, best): each query's largest cosine in each group; (group, best) of any query where ``group`` is vec_id.

    Scores are matrix products, and only maxima leave a task. Up to
    ``BROADCAST_QUERIES`` queries go to every task; more are dealt to groups, each of
    which meets every block of vectors once, and the groups' maxima are merged.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "q")
    alone = group == "vec_id"
    names = ["vec_id", "best"] if alone else ["query_id", group, "best"]
    schema = ", ".join(f"{n} double" if n == "best" else f"{n} long" for n in names)
    rows = vectors.select(F.col(group).cast("long").alias("key"), "embedding")

    def maxima(ids: np.ndarray, matrix: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[np.ndarray]]:
        held: dict[int, np.ndarray] = {}
        for keys, embeddings in parts:
            scores = matrix @ embeddings.T
            if alone:
                yield [keys, scores.max(0)]
                continue
            for key in np.unique(keys):
                most = scores[:, keys == key].max(1)
                held[int(key)] = np.maximum(held[int(key)], most) if int(key) in held else most
        for key, most in held.items():
            yield [ids, np.full(len(ids), key), most]

    if asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        table = asked.toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            if len(ids):
                parts = ((b.column(0).to_numpy(), _matrix(b.column(1), matrix.shape[1])) for b in batches if b.num_rows)
                for columns in maxima(ids, matrix, parts):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        found = rows.mapInArrow(run, schema)
    else:
        blocks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        groups = -(-asked.count() // BROADCAST_QUERIES)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.withColumn("block", F.pmod(F.xxhash64("embedding"), F.lit(blocks)).cast("int")).withColumn("part", every(groups))
        right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))

        def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            matrix = _matrix(pa.array(q["q"]))
            parts = ((v["key"].to_numpy()[i : i + HELD_VECTORS], _matrix(pa.array(v["embedding"].iloc[i : i + HELD_VECTORS]), matrix.shape[1])) for i in range(0, len(v) if len(q) else 0, HELD_VECTORS))
            made = list(maxima(q["query_id"].to_numpy(), matrix, parts))
            return pd.DataFrame(dict(zip(names, [np.concatenate(c) for c in zip(*made, strict=True)] if made else [[] for _ in names], strict=True)))

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, schema)
    return found.groupBy(*names[:-1]).agg(F.round(F.max("best"), 6).alias("best"))


def rrf(arms: dict[str, DataFrame], key: list[str], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: arms (key, rank) become one score with each arm's rank."""
    tagged = [a.select(*key, F.lit(name).alias("arm"), (F.lit(1.0) / (constant + F.col("rank"))).alias("part")) for name, a in arms.items()]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(*key).agg(F.round(F.sum("part"), 8).alias("score"), F.count("*").alias("arms"))


def densest(words: Column, terms: list[str], width: int) -> Column:
    """(score, at) of the first window of ``width`` words with the most hits; a word hits if it contains a term.

    A best window that begins earliest begins at the start or ends at a hit, so
    only the hits are looked at, each with the ``width`` hits before it.
    """
    n = F.size(words)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.get(words, i)), t)))

    def best(hits: Column) -> Column:
        last = F.greatest(n - width, F.lit(0))
        start = F.struct(F.size(F.filter(F.slice(hits, 1, width), lambda p: p < width)).alias("score"), F.lit(0).alias("minus"))

        def window(p: Column, j: Column) -> Column:
            back = F.filter(F.sequence(F.lit(0), F.least(j, F.lit(width - 1))), lambda k: F.get(hits, j - k) > p - width)
            return F.struct(F.size(back).alias("score"), (-(p - width + 1)).alias("minus"))

        ends = F.filter(F.transform(hits, window), lambda w: (-w["minus"] > 0) & (-w["minus"] <= last))
        return F.array_max(F.concat(F.array(start), ends))

    # The hits are bound once, as the element of an array of one.
    found = F.get(F.transform(F.array(hits), best), F.lit(0))
    return F.struct(found["score"].cast("long").alias("score"), (-found["minus"]).cast("long").alias("at"))


def best_passage(docs: DataFrame, terms: list[str], doc: str, width: int = 25, text: str = "text") -> DataFrame:
    """(doc, score, at): the densest window of each document's words; documents without words have none."""
    ws = docs.select(doc, X.blank_split(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    return ws.select(doc, densest(F.col("ws"), terms, width).alias("w")).select(doc, "w.score", "w.at")
