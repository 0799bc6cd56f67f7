"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Equal vectors are one vertex, with as many of their smallest ids as an answer
can hold. Vertices are dealt by hash into shards of bounded size. In a shard a
greedy search over the graph so far proposes neighbours for a batch of vertices
and relaxed distance pruning keeps a diverse few; reverse edges are added and
pruned alike. A query is answered by a beam search in every shard, in blocks of
queries, and the shards' answers are merged.

Inner products become distances by one more component, the square root of the
shard's largest squared norm less the vector's own, so that vectors of any
length can be searched.

Edge cases: vectors that are null, empty, zero, or that hold null or non-finite
components take no part; vectors of each width are an index of their own, which
queries of that width alone meet; a query's own row never answers it, though an
equal vector of another row does; repeated rows count once; of an id with several
vectors, each is searched and found, and an answer has the id once, by the best
score of its vectors, those of the query's id included; equal scores go to the
smaller id; rows with a null id take no part; with fewer candidates all are given; no rows give no rows; only the id
and the vector are read, so that no other column can clash.
"""

from __future__ import annotations

import io
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import written

SHARD_ROWS = 4096
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, BATCH = 32, 64, 96, 1.2, 256
QUERY_BLOCK = 4096


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): the rows whose vectors are finite and not zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def vertices(rows: DataFrame, keep: int) -> DataFrame:
    """(h, v, ids): each distinct vector with its ``keep`` smallest ids.

    Ids are ranked in two levels, so that a vector of very many rows is dealt out.
    """
    keyed = rows.distinct().withColumn("h", F.xxhash64("v")).withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    few = keyed.withColumn("r", rank("h", "v", "deal")).where(F.col("r") <= keep)
    few = few.withColumn("r", rank("h", "v")).where(F.col("r") <= keep)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, beam: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points that a greedy search finds for each query, and their distances.

    All queries step together; a query is done when its whole beam is expanded.
    """
    n, m = len(points), len(queries)
    norms = (points**2).sum(1)
    ids = np.full((m, beam), n, np.int64)
    distances = np.full((m, beam), np.inf, np.float32)
    expanded = np.zeros((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    ids[:, 0], distances[:, 0] = start, norms[start] - 2 * queries @ points[start]
    seen[:, start] = seen[:, n] = True
    active = np.arange(m)
    while len(active):
        todo = np.where(expanded[active], np.inf, distances[active])
        pick = todo.argmin(1)
        live = np.isfinite(todo[np.arange(len(active)), pick])
        active, pick = active[live], pick[live]
        if not len(active):
            break
        expanded[active, pick] = True
        near = graph[ids[active, pick]]
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        near = np.where(new, near, n)
        inner = np.minimum(near, n - 1)
        d = norms[inner] - 2 * np.einsum("qd,qrd->qr", queries[active], points[inner])
        d = np.where(near == n, np.inf, d).astype(np.float32)
        all_ids, all_d = np.concatenate([ids[active], near], 1), np.concatenate([distances[active], d], 1)
        all_e = np.concatenate([expanded[active], np.zeros_like(new)], 1)
        top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        row = np.arange(len(active))[:, None]
        ids[active], distances[active], expanded[active] = all_ids[row, top], all_d[row, top], all_e[row, top]
    return ids, distances


def prune(points: np.ndarray, targets: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each target the candidates that no kept, nearer one covers; ``n`` fills up."""
    n = len(points)
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    candidates[candidates == targets[:, None]] = n
    known = candidates < n
    near = points[np.minimum(candidates, n - 1)]
    to_target = np.where(known, ((near - points[targets][:, None]) ** 2).sum(2), np.inf)
    norms = (near**2).sum(2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    kept = np.full((len(targets), degree), n, np.int64)
    row, left = np.arange(len(targets)), to_target.copy()
    for k in range(degree):
        pick = left.argmin(1)
        live = np.isfinite(left[row, pick])
        if not live.any():
            break
        kept[live, k] = candidates[row, pick][live]
        covered = relax**2 * between[row, pick] <= to_target
        left[covered | ~live[:, None]] = np.inf
        left[row, pick] = np.inf
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """The graph of a shard's points (``n`` marks no edge) and its entry point."""
    n = len(points)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    random = np.random.default_rng(n)
    graph = np.full((n, degree), n, np.int64)
    if n > 1:
        graph[:, : min(8, n - 1)] = random.integers(0, n, (n, min(8, n - 1)))
    order = random.permutation(n)
    for sweep_relax in (1.0, relax):
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            found, _ = search(points, graph, points[batch], beam, start)
            graph[batch] = prune(points, batch, np.concatenate([found, graph[batch]], 1), degree, sweep_relax)
            source, target = np.repeat(batch, degree), graph[batch].ravel()
            source, target = source[target < n], target[target < n]
            order2 = np.argsort(target, kind="stable")
            source, target = source[order2], target[order2]
            heads, first, counts = np.unique(target, return_index=True, return_counts=True)
            for lo in range(0, len(heads), BATCH):
                part = heads[lo : lo + BATCH]
                width = int(counts[lo : lo + BATCH].max())
                extra = np.full((len(part), width), n, np.int64)
                for i, (f, c) in enumerate(zip(first[lo : lo + BATCH], counts[lo : lo + BATCH], strict=True)):
                    extra[i, :c] = source[f : f + c]
                both = np.concatenate([graph[part], extra], 1)
                free = (both < n).sum(1) <= degree
                packed = np.sort(both[free], 1)
                packed[:, 1:][packed[:, 1:] == packed[:, :-1]] = n
                graph[part[free]] = np.sort(packed, 1)[:, :degree]
                if (~free).any():
                    graph[part[~free]] = prune(points, part[~free], both[~free], degree, sweep_relax)
    return graph, start


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """One more component makes the nearest point that of the largest inner product."""
    rest = np.sqrt(np.maximum(largest - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], 1).astype(np.float32)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("h", kind="stable")
    parts = []
    widths = pdf["v"].map(len)
    for _, part in pdf.groupby(widths):  # vectors of one width make one graph
        vectors = np.stack([np.asarray(x, np.float64) for x in part["v"]])
        graph, start = build(lifted(vectors, (vectors**2).sum(1).max()))
        ids = np.concatenate([np.asarray(x, np.int64) for x in part["ids"]])
        ends = np.cumsum([len(x) for x in part["ids"]])
        parts.append(_packed(vectors=vectors, graph=graph.astype(np.int32), start=np.array(start), ids=ids, ends=ends))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])] * len(parts), "graph": parts})


def index(vectors: DataFrame, keep: int, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The shards' graphs, a row each, written to the shared folder, and how many shards there are."""
    points = written(vertices(usable(vectors, vec_id, vector), keep), "vertices")
    shards = max(1, -(-points.count() // shard_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(5)), F.lit(shards)))
    return written(dealt.groupBy("shard").applyInPandas(_build_shard, "shard long, graph binary"), "graphs"), shards


def nearest(graphs: DataFrame, shards: int, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for rows (query_id, v); repeated rows ask once."""
    queries = queries.select("query_id", "v").distinct()
    if not queries.take(1):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    asked = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def answer(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for blob in graph["graph"] if len(block) else ():
            got = np.load(io.BytesIO(blob))
            base, ids, ends = got["vectors"], got["ids"], got["ends"]
            starts = np.concatenate([[0], ends[:-1]])
            same = block[block["v"].map(len) == base.shape[1]]
            if not len(same):
                continue
            points = lifted(base, (base**2).sum(1).max())
            asked = np.stack([np.asarray(x, np.float64) for x in same["v"]])
            # The order of the answers does not depend on a query's length: each is searched at length one.
            unit = np.concatenate([asked / np.sqrt((asked**2).sum(1, keepdims=True)), np.zeros((len(asked), 1))], 1).astype(np.float32)
            found, _ = search(points, got["graph"].astype(np.int64), unit, min(beam, len(points)), int(got["start"]))
            for q, vector, near in zip(same["query_id"], asked, found, strict=True):
                near = near[near < len(points)]
                held = ends[near] - starts[near]
                rows = np.concatenate([ids[starts[p] : ends[p]] for p in near])
                scores = np.repeat((base[near] * vector).sum(1), held)
                rows, scores = rows[rows != q], scores[rows != q]
                order = np.lexsort((rows, -scores))
                best = order[np.sort(np.unique(rows[order], return_index=True)[1])[:k]]  # each id once, by its best score
                out.append((np.full(len(best), q, np.int64), rows[best], scores[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))

    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = copies.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
