"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most ``CAPACITY`` tokens. Only the count of
pieces of each length (at most ``CAPACITY`` numbers) reaches the driver, which
runs best-fit decreasing over counts: bins of equal content are one group. The
plan says which ranks of a length go to which run of sequences; pieces then
take their slots by their rank within their length. Ranks come from a
two-level count, so a length that holds most of the pieces is still dealt out.

Edge cases: a null or empty text is the one end token; repeated rows are packed
once each, and ties in length take any slots; a null doc_id keeps its pieces; a
text of any length is cut into pieces, none is dropped; an empty table gives no
rows; only doc_id and text are read, so that no other column can clash.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import small_batches, written

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked in one task.
RANKED_TOGETHER = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from texts to arrays of ids, by a byte-level BPE file in JSON.

    If the file's merges are in the order of its ids, as in the known byte-level
    vocabularies, a rank table gives the same ids several times faster;
    otherwise the file's own library encodes.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    # The byte-level alphabet: printable bytes stand for themselves, the others follow from code 256.
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    plain = model["type"] == "BPE" and not content.get("normalizer") and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and not model.get("dropout")
    if plain:
        import public_tokenizers
        import tiktoken

        special = {x["content"] for x in content.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: encoding.encode_ordinary(text)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; only the first of several may be shorter."""

    def run(batches):
        encode = tokenizer(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                at, n, k = 0, len(ids), 0
                while at < n:
                    stop = at + ((n - at) % capacity or capacity)
                    for column, value in zip(out, (doc_id, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())), strict=True):
                        column.append(value)
                    at, k = stop, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows: (length, first rank, ranks, pieces to a sequence, first sequence,
    offset of the first piece). A group is a run of sequences with equal
    content; a length fills the fullest groups that still have room.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (first sequence, count)
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, count: int, free: int) -> None:
            """Put pieces into a run of sequences; what stays free goes back."""
            nonlocal left, rank
            each = free // length
            full = min(count, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, capacity - free))
                rank, left = rank + full * each, left - full * each
                room[free - each * length].append((first, full))
            if left and full < count and left < each:
                rows.append((length, rank, left, left, first + full, capacity - free))
                room[free - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < count:
                room[free].append((first + full, count - full))

        for free in sorted(x for x in room if x >= length):
            if not left:
                break
            for first, count in room.pop(free):
                if left:
                    fill(first, count, free)
                else:
                    room[free].append((first, count))
        if left:
            count = -(-left // (capacity // length))
            first, sequences = sequences, sequences + count
            fill(first, count, capacity)
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece with its sequence and its place there."""
    spark = docs.sparkSession
    small_batches(spark)
    table = written(pieces(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, n long, each long, first long, base long")
    lengths = spark.createDataFrame([(k, -(-v // RANKED_TOGETHER)) for k, v in histogram.items()], "length long, buckets long")
    # Both tables have a few rows for each possible length, whatever the corpus holds.
    dealt = table.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets"))
    by_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("rows")).withColumn("skip", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    ranked = dealt.withColumn("row", F.row_number().over(by_bucket)).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("row") - 1 + F.col("skip"))
    placed = ranked.alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")))
    step = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (step % F.col("each")) * F.col("p.length")).cast("long").alias("offset"),
    )
