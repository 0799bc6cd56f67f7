"""Language identification by string kernels.

A text is the set of byte n-grams it contains, for several orders n (a blended
spectrum of presence features, hashed to a fixed width for each order). The
kernel of two texts is the mean over orders of shared n-grams over the
geometric mean of the set sizes. Nystroem landmarks turn the kernel into
features of fixed width, one-versus-rest ridge regression is solved on these,
and texts are scored by batched matrix products.

The model is fitted on at most ``SAMPLE_PER_LANGUAGE`` labelled rows for each
language, the first by a hash of the id; everything else reads all rows.

Edge cases: a text that is null or has no letter is ``und`` with score 1; with
no labelled row every text is ``und`` with score 0; of equal scores the first
label in order wins; repeated rows get equal results; a null id is like any
other, a null lang is no label; a text of any length is read whole, in segments;
no rows give no rows; a new column whose name is in use gets underscores until
it is free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.common import append_columns, small_batches, utf8

#: Byte n-gram orders and the width to which each is hashed.
ORDERS = ((1, 256), (2, 4096), (3, 8192))
WIDTH = sum(w for _, w in ORDERS)
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-3
SHARPNESS = 6.0
#: Texts and bytes that are turned into one matrix.
CHUNK_ROWS, CHUNK_BYTES = 256, 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
UNKNOWN = "und"


def presence(texts: list[bytes]) -> np.ndarray:
    """A row of 0/1 features for each text."""
    found = np.zeros((len(texts), WIDTH), np.uint8)
    flat = found.reshape(-1)
    for rows, data in segments(texts, CHUNK_BYTES, max(n for n, _ in ORDERS) - 1):
        data = LOWER[data].astype(np.uint32)
        start = 0
        for n, width in ORDERS:
            if len(data) >= n:
                code = data[: len(data) - n + 1].copy()
                for k in range(1, n):
                    code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
                if width < 256**n:
                    code = (code * np.uint32(2654435761)) >> np.uint32(32 - (width.bit_length() - 1))
                same = rows[: len(code)] == rows[n - 1 :]
                flat[rows[: len(code)][same] * WIDTH + start + code[same]] = 1
            start += width
    return found


def segments(texts: list[bytes], size: int, overlap: int):
    """Runs of bytes with the row of each byte; long texts come in overlapping parts."""
    parts: list[tuple[int, bytes]] = []
    held = 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            part = text[at : at + size]
            parts.append((row, part))
            held += len(part)
            if held >= size:
                yield _joined(parts)
                parts, held = [], 0
            if at + size >= len(text):
                break
            at += size - overlap
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
    return np.repeat(np.array([r for r, _ in parts], np.int64), [len(p) for _, p in parts]), data


def chunks(texts: list[bytes]):
    """Row ranges of bounded count and size; a longer text stands alone."""
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and stop - at < CHUNK_ROWS and (stop == at or held + len(texts[stop]) <= CHUNK_BYTES):
            held += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The blended kernel of two presence matrices; ``right`` is float already."""
    out = np.zeros((len(left), len(right)), np.float32)
    start = 0
    for _, width in ORDERS:
        a, b = left[:, start : start + width].astype(np.float32), right[:, start : start + width]
        sizes = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
        out += (a @ b.T) / sizes
        start += width
    return out / len(ORDERS)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray  # landmarks x languages: whitening and ridge in one

    def scores(self, features: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        margins = kernel(features, landmarks).astype(np.float64) @ self.weights
        e = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit(features: np.ndarray, labels: list[str]) -> Model:
    """Landmarks are the first rows of each language; rows come in hash order."""
    languages = sorted(set(labels))
    index = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(index == k)[:LANDMARKS_PER_LANGUAGE] for k in range(len(languages))])
    landmarks = features[chosen].astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(features[chosen], landmarks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whitening = vectors[:, keep] / np.sqrt(values[keep])
    mapped = kernel(features, landmarks).astype(np.float64) @ whitening
    targets = np.where(index[:, None] == np.arange(len(languages)), 1.0, -1.0)
    ridge = mapped.T @ mapped + RIDGE * len(labels) * np.eye(mapped.shape[1])
    return Model(languages, features[chosen], whitening @ np.linalg.solve(ridge, mapped.T @ targets))


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> Model | None:
    """Fit on a bounded sample of ``labelled``; None if there is no labelled row."""
    spark = labelled.sparkSession
    small_batches(spark)
    key = F.xxhash64("doc_id")
    ids = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    # Ranked in two levels and without texts: a language that holds most rows is dealt out first.
    turn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(key, "doc_id"))
    first = ids.withColumn("deal", F.pmod(key, F.lit(61))).withColumn("turn", turn("label", "deal")).where(F.col("turn") <= SAMPLE_PER_LANGUAGE)
    chosen = first.select("doc_id", "label").withColumn("turn", turn("label")).where(F.col("turn") <= SAMPLE_PER_LANGUAGE).select("doc_id", "label").distinct()
    # SAMPLE_PER_LANGUAGE ids for each language: a bounded table.
    sample = labelled.select("doc_id", F.col(text).alias("text"), F.col(label).alias("label")).join(F.broadcast(chosen), ["doc_id", "label"]).select("text", "label", "doc_id")

    def compute():
        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            texts = utf8(rows.column(0))
            return [pa.array([np.packbits(presence([x])[0]).tobytes() for x in texts], pa.binary())]

        return batch

    made = append_columns(sample.where("length(text) > 0"), [T.StructField("features", T.BinaryType())], compute)
    found = made.groupBy("label", "doc_id").agg(F.min("features").alias("features")).withColumn("key", key).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["label"], r["key"], r["doc_id"]))
    features = np.stack([np.unpackbits(np.frombuffer(r["features"], np.uint8))[:WIDTH] for r in found])
    return fit(features, [r["label"] for r in found])


def identify(frame: DataFrame, model: Model | None, text: str = "text", output: str = "lang_pred", score: str = "score") -> DataFrame:
    """``frame`` with the predicted language and its score; other columns stay."""
    small_batches(frame.sparkSession)

    def compute():
        landmarks = None if model is None else model.landmarks.astype(np.float32)

        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            column = rows.column(rows.schema.names.index(text))
            texts, names, scores = utf8(column), [], []
            lettered = [any(map(str.isalpha, x)) for x in (y.as_py() or "" for y in column)]
            for at, stop in chunks(texts):
                if model is None:
                    names += [UNKNOWN] * (stop - at)
                    scores += [0.0] * (stop - at)
                    continue
                found = model.scores(presence(texts[at:stop]), landmarks)
                best = found.argmax(1)
                for i, k in enumerate(best):
                    names.append(model.languages[k] if lettered[at + i] else UNKNOWN)
                    scores.append(float(found[i, k]) if lettered[at + i] else 1.0)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return batch

    return append_columns(frame, [T.StructField(output, T.StringType()), T.StructField(score, T.DoubleType())], compute)
