"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics come from byte counts, counts of transitions between byte classes,
and repeated words and lines. Trees grow level by level on binned statistics
and are flattened into arrays; a batch of rows walks all of them at once in
numpy. The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, the first
by a hash of the id; everything else reads all rows.

Edge cases: null and empty texts have all statistics zero and get a score as
any other text; with no labelled row every score is 0.5, with one class the
prior; labels of null ids or null quality do not count, of several labels of one
id the largest; repeated rows get equal scores, and so do ties; null ids are
scored like any other; a text of any length is read whole; no rows give no rows;
a new column whose name is in use gets underscores until it is free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.common import append_columns, small_batches, utf8
from lexweave.llm.langid import chunks, segments

SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS = 80, 4, 32
LEARNING_RATE, LEAF_PENALTY, LEAF_ROWS = 0.15, 1.0, 10

# Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 punctuation, 7 beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[9, 32]], CLASS[[10, 13]] = 1, 2, 3, 4, 5
CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 6
CLASS[128:] = 7
SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
N_FEATURES = 8 + 64 + len(SIGNS) + 8


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each text."""
    n = len(texts)
    counts, moves = np.zeros((n, 256)), np.zeros((n, 64))
    for rows, data in segments(texts, 1 << 20, 0):
        counts += np.bincount(rows * 256 + data, minlength=n * 256).reshape(n, 256)
        kinds = CLASS[data].astype(np.int64)
        same = rows[1:] == rows[:-1]
        moves += np.bincount((rows[1:] * 64 + kinds[:-1] * 8 + kinds[1:])[same], minlength=n * 64).reshape(n, 64)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    share = counts / total
    kinds = np.stack([share[:, CLASS == k].sum(1) for k in range(8)], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    words = [x.split() for x in texts]
    lines = [[y for y in x.split(b"\n") if y] for x in texts]
    n_words = np.array([len(x) for x in words], float)
    n_lines = np.array([len(x) for x in lines], float)
    rest = np.stack(
        [
            np.log1p(counts.sum(1)),
            n_words / np.maximum(n_lines, 1),
            (total[:, 0] - share[:, [9, 10, 13, 32]].sum(1) * total[:, 0]) / np.maximum(n_words, 1),
            np.array([len(set(x)) for x in words]) / np.maximum(n_words, 1),
            np.array([len(set(x)) for x in lines]) / np.maximum(n_lines, 1),
            np.log1p(n_words),
            entropy,
            share.max(1),
        ],
        1,
    )
    found = np.concatenate([kinds, moves / total, share[:, SIGNS], rest], 1)
    found[[not x for x in texts]] = 0
    return found.astype(np.float32)


@dataclass
class Trees:
    """Complete trees in arrays: node k of a tree has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, one histogram of gradients for each statistic and level."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    inner = 2**DEPTH - 1
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.int64)
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            at = node - first
            best, cut_at = np.zeros(count), np.full((count, 2), -1)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                key = at * BINS + binned[:, j]
                g = np.bincount(key, gradient, count * BINS).reshape(count, BINS).cumsum(1)
                h = np.bincount(key, weight, count * BINS).reshape(count, BINS).cumsum(1)
                c = np.bincount(key, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                gain = g**2 / (h + LEAF_PENALTY) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + LEAF_PENALTY) - g[:, -1:] ** 2 / (h[:, -1:] + LEAF_PENALTY)
                gain[(c < LEAF_ROWS) | (c[:, -1:] - c < LEAF_ROWS)] = 0
                gain = gain[:, : len(cuts[j])]
                top = gain.argmax(1)
                better = gain[np.arange(count), top] > best
                best[better] = gain[np.arange(count), top][better]
                cut_at[better] = np.stack([np.full(count, j), top], 1)[better]
            for k in range(count):
                if cut_at[k, 0] >= 0:
                    feature[first + k], threshold[first + k] = cut_at[k, 0], cuts[cut_at[k, 0]][cut_at[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        value = LEARNING_RATE * g / (h + LEAF_PENALTY)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(values))


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality") -> Trees:
    """Fit on a bounded sample of the labelled rows for which ``held_out`` is false.

    ``held_out`` is a function from the id column to a condition. The ids of the
    sample, ``SAMPLE_ROWS`` at most, are broadcast; a document's text goes no further
    than the statistics made from it.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = marked.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id")

    def compute():
        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            texts = utf8(rows.column(0))
            return [pa.array([statistics(texts[i : i + 1])[0].tobytes() for i in range(len(texts))], pa.binary())]

        return batch

    made = append_columns(rows, [T.StructField("features", T.BinaryType())], compute)
    found = made.groupBy("doc_id").agg(F.min("features").alias("features"), F.max("label").alias("label")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["features"]))
    x = np.stack([np.frombuffer(r["features"], np.float32) for r in found]) if found else np.zeros((0, N_FEATURES), np.float32)
    return boost(x, np.array([float(r["label"] > 0) for r in found]))


def score(frame: DataFrame, model: Trees, text: str = "text", output: str = "score") -> DataFrame:
    """``frame`` with the score of each text; other columns stay."""
    small_batches(frame.sparkSession)

    def compute():
        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            texts = utf8(rows.column(rows.schema.names.index(text)))
            found = [model.score(statistics(texts[a:b])) for a, b in chunks(texts)]
            return [pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())]

        return batch

    return append_columns(frame, [T.StructField(output, T.DoubleType())], compute)
