"""An approximate vector index with filters: inverted lists, residual codes, exact rerank.

Centroids and codebooks are trained on a bounded sample of unit vectors; every
vector is then indexed: its list is that of its nearest centroid, its code the
nearest codeword of each part of what the centroid leaves over. A search
probes the lists nearest to each query. Rows of the lists are dealt to parts of
bounded size, each of which meets the queries that probe its list, as arrays;
only the best by code leave a part, and are scored on the vectors themselves.

Filters are applied to the rows of the lists, before anything is cut off, so
that they never starve an answer from within a list; queries whose lists hold too
few rows that pass probe four times as many lists, until they have ``k`` rows or
have seen all lists. Answers are full, then, wherever ``k`` rows pass.

Edge cases: vectors that are null, zero, not finite or not of the sample's most common
width take no part, queries neither; repeated rows of one id count once; ties go to
the smaller id; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.operators.retrieval import BROADCAST_TERMS, cosine, cosine_top_k, small_side, top_k
from lexweave.session import settled

#: Vectors that centroids and codebooks are trained on, the first by a hash of the id; lists at most; parts of a vector; codewords.
SAMPLE, LISTS, PARTS, WORDS, ROUNDS = 20_000, 1024, 16, 256, 10
#: Rows by code for each row of the answer, rows of a part.
OVERFETCH, PART_ROWS = 8, 8192
#: Queries whose exact neighbours are looked for, the first by a hash of the id; rows by code that their ranks are told from; share of the neighbours that the lists, and the codes, are to reach.
TRIED, TRIED_ROWS, REACHED = 100, 4096, 0.98


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centroids, fewer if there are fewer rows; centroids without rows move to the rows that are worst off."""
    k = min(k, len(x))
    centroids = x[np.random.default_rng(k).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at, near = nearest(x, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = x[np.argsort(-near, kind="stable")[: len(empty)]]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance."""
    apart = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
    at = apart.argmin(1)
    return at, apart[np.arange(len(x)), at]


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x width
    books: list[np.ndarray]  # of each part, words x its width
    ends: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of unit vectors."""
        at, _ = nearest(x, self.centroids)
        rest = x - self.centroids[at]
        codes = [nearest(rest[:, a:b], book)[0] for book, a, b in zip(self.books, self.ends, self.ends[1:], strict=False)]
        return at, np.stack(codes, 1).astype(np.uint8)

    def table(self, q: np.ndarray) -> np.ndarray:
        """Inner products of a query's parts with all codewords, padded to ``WORDS``."""
        out = np.zeros((len(self.books), WORDS))
        for i, (book, a, b) in enumerate(zip(self.books, self.ends, self.ends[1:], strict=False)):
            out[i, : len(book)] = book @ q[a:b]
        return out


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that can be indexed, and their vectors at length one."""
    rows = column.to_pylist()
    fit = [i for i, r in enumerate(rows) if r is not None and len(r) == width and None not in r]
    x = np.array([rows[i] for i in fit], float).reshape(-1, width)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return np.array(fit, np.int64)[good], x[good] / norm[good, None]


@dataclass
class VectorIndex:
    quantiser: Quantiser | None
    width: int
    lists: DataFrame | None  # list, part, vec_id, code and the kept columns, in the order of the lists
    vectors: DataFrame  # vec_id, embedding
    parts: DataFrame | None  # list, parts: a row to a list


def index(vectors: DataFrame, columns: list[str] | None = None, lists: int | None = None) -> VectorIndex:
    """The index of rows (vec_id, embedding) with the columns that filters may name."""
    columns = columns or []
    rows = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *columns).dropDuplicates(["vec_id"])
    rows = settled(rows)
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column(0).combine_chunks()
    widths = Counter(len(r) for r in sample.to_pylist())
    width = max(widths, key=lambda w: (widths[w], w), default=1)
    _, x = unit_rows(sample, width)
    if not len(x):
        return VectorIndex(None, width, None, rows, None)
    n = rows.count()
    centroids = kmeans(x, lists or int(np.clip(np.sqrt(n), 1, LISTS)))
    rest = x - centroids[nearest(x, centroids)[0]]
    ends = np.linspace(0, width, min(PARTS, width) + 1).round().astype(int)
    quantiser = Quantiser(centroids, [kmeans(rest[:, a:b], WORDS) for a, b in zip(ends, ends[1:], strict=False)], ends)
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column(1), width)
            lists, codes = shared.value.encode(x) if len(at) else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
            kept = [batch.column(i).take(pa.array(at)) for i in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), *kept], ["list", "code", "vec_id", *columns])

    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), *(rows.schema[c] for c in ["vec_id", *columns])])
    coded = rows.mapInArrow(run, schema)
    held = settled(coded.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id"))
    parts = settled(held.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")))  # LISTS rows at most
    return VectorIndex(quantiser, width, held, rows, parts)


def search(found: VectorIndex, queries: DataFrame, k: int, where: str | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest found by cosine, to six places, of the rows that pass ``where``.

    Without ``probes`` the lists to probe at first are measured on a sample of the queries.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).where("query_id is not null").dropDuplicates(["query_id"])
    if found.quantiser is None:
        return asked.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).limit(0)
    shared, width, n_lists = asked.sparkSession.sparkContext.broadcast(found.quantiser), found.width, len(found.quantiser.centroids)
    rows = found.lists if where is None else found.lists.where(where)
    dealt = rows.join(F.broadcast(found.parts), "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), "vec_id", "code")

    def probed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = unit_rows(batch.column(1), width)
                nearness = x @ shared.value.centroids.T - (shared.value.centroids**2).sum(1) / 2
                m = min(n, n_lists)
                best = np.argpartition(-nearness, m - 1, axis=1)[:, :m] if len(at) else np.zeros((0, m), int)
                ids = batch.column(0).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(best.ravel().astype(np.int32)), pa.array(np.repeat(x, m, axis=0).tolist(), pa.list_(pa.float64()))], ["query_id", "list", "q"])

        return run

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of a row's list among those that a query probes."""
        for batch in batches:
            at, x = unit_rows(batch.column(0), width)
            nearness = x @ shared.value.centroids.T - (shared.value.centroids**2).sum(1) / 2
            own = nearness[np.arange(len(at)), batch.column(1).to_numpy()[at]]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at)), pa.array((nearness > own[:, None]).sum(1) + 1)], ["query_id", "vec_id", "place"])

    def meet(rows: pa.Table, asked: pa.Table, take: int) -> pa.Table:
        ids, codes = rows.column("vec_id").to_numpy(), np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8)
        out: list[tuple] = []
        if len(ids):
            codes = codes.reshape(len(ids), -1).T.astype(np.int64)
            for query, at, q in zip(asked.column("query_id").to_pylist(), asked.column("list").to_pylist(), asked.column("q").to_pylist(), strict=True):
                q = np.array(q)
                scores = q @ shared.value.centroids[at] + np.take_along_axis(shared.value.table(q), codes, 1).sum(0)
                best = np.argpartition(-scores, take - 1)[:take] if len(ids) > take else np.arange(len(ids))
                out.append((np.full(len(best), query), ids[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))

    def by_code(left: DataFrame, probes: int, take: int) -> DataFrame:
        """(query_id, vec_id, rank): the first ``take`` rows by code of the lists that a query probes."""
        probing = left.mapInArrow(probed(probes), "query_id long, list int, q array<double>").join(F.broadcast(found.parts), "list")
        probing = probing.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("list", "part", "query_id", "q")
        near = dealt.groupBy("list", "part").cogroup(probing.groupBy("list", "part")).applyInArrow(lambda rows, asked: meet(rows, asked, take), "query_id long, vec_id long, score double")
        return top_k(near, take, ["query_id"], [F.desc("score"), F.asc("vec_id")]).select("query_id", "vec_id", "rank")

    def tried() -> tuple[int, int]:
        """Lists to probe and rows to score by their vectors, as the exact neighbours of some of the queries tell."""
        some = settled(left.orderBy(F.xxhash64("query_id"), "query_id").limit(TRIED))
        passing = found.vectors.join(rows.select("vec_id"), "vec_id", "left_semi")
        exact = settled(cosine_top_k(passing, some, k).select("query_id", "vec_id"))
        near = exact.join(rows.select("vec_id", "list"), "vec_id").join(F.broadcast(some), "query_id").select("q", "list", "query_id", "vec_id")
        ranks = near.mapInArrow(listed, "query_id long, vec_id long, place long").join(by_code(some, n_lists, TRIED_ROWS), ["query_id", "vec_id"], "left")
        told = ranks.select("place", "rank").collect()  # TRIED * k rows at most
        if not told:
            return n_lists, k * OVERFETCH
        at = int(np.ceil(REACHED * len(told))) - 1
        rank = sorted(r["rank"] or np.inf for r in told)[at]
        return sorted(r["place"] for r in told)[at], int(max(k * OVERFETCH, min(rank, np.iinfo(np.int32).max)))

    answers, left, take = None, settled(asked), k * OVERFETCH
    if probes is None:
        probes, take = tried()
    while True:
        coded = by_code(left, probes, take).drop("rank")
        exact = found.vectors.select("vec_id", "embedding").join(small_side(settled(coded), BROADCAST_TERMS), "vec_id").join(small_side(left, BROADCAST_TERMS), "query_id")
        exact = exact.select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
        best = settled(top_k(exact, k, ["query_id"], [F.desc("score"), F.asc("vec_id")]))
        full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        if probes >= n_lists:
            return best if answers is None else answers.unionByName(best)
        done = best.join(full, "query_id", "left_semi")
        answers = done if answers is None else answers.unionByName(done)
        left = settled(left.join(full, "query_id", "left_anti"))
        if not left.take(1):
            return answers
        probes *= 4
