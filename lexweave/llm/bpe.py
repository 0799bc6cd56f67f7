"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is split by the tokenizer's pattern and each match is encoded alone.
A match is encoded as a tree: halves are encoded recursively and two
neighbouring results are joined. Joining re-encodes a window around the
boundary; the window grows until the tokens outside are stable.

Why that is exact: let a token sequence be *valid* if encoding its bytes gives
it back. No merge can cross the boundary of two adjacent tokens before a merge
crosses it in the encoding of just these two, because until then either side
merges as it does alone. So a sequence is valid if and only if each adjacent
pair is. A join keeps valid runs outside the window and puts a valid run into
it; only the two pairs at the window's ends remain to be tested.

Edge cases: null and empty texts give no tokens; decoding any encoding gives the
text's own bytes; of equal ranks the leftmost pair merges first; a text of any
length is encoded whole; repeated rows and null ids are like any others; no rows
give no rows; a new column whose name is in use gets underscores until it is free.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexweave.llm.common import append_columns, utf8

#: Distinct matches, token pairs and halves a worker remembers at once.
CACHE_ENTRIES = 200_000
#: Bytes up to which a part of a match is merged directly.
LEAF_BYTES = 8
#: Bytes up to which a merge looks for the best pair by scanning.
SCANNED_BYTES = 40


class TreeBpe:
    """The encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._parts: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals: few bytes by scans, more by a heap."""
        n = len(data)
        ranks = self.ranks
        if n < 2:
            return [ranks[data]] if n else []
        if n <= SCANNED_BYTES:
            get, none = ranks.get, len(self.tokens)
            parts = [data[i : i + 1] for i in range(n)]
            scores = [get(data[i : i + 2], none) for i in range(n - 1)]
            while scores:
                best = min(scores)
                if best == none:
                    break
                i = scores.index(best)
                parts[i] += parts.pop(i + 1)
                del scores[i]
                if i:
                    scores[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(scores):
                    scores[i] = get(parts[i] + parts[i + 1], none)
            return [ranks[x] for x in parts]
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= stop or end[middle] != stop:
                continue
            alive[middle] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                rank = ranks.get(data[i : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            left = before[i]
            if left >= 0:
                rank = ranks.get(data[left:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _pair(self, a: int, b: int) -> list[int]:
        """The encoding of two adjacent tokens' bytes."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return found

    def _stable(self, a: int, b: int) -> bool:
        return self._pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes from their encodings."""
        if not left or not right:
            return left or right
        a, b, step = len(left) - 1, 1, 1
        window = self._pair(left[a], right[0])
        while True:
            left_ok = a == 0 or self._stable(left[a - 1], window[0])
            right_ok = b == len(right) or self._stable(window[-1], right[b])
            if left_ok and right_ok:
                return left[:a] + window + right[b:]
            if not left_ok:
                a = max(0, a - step)
            if not right_ok:
                b = min(len(right), b + step)
            step *= 2
            window = self.merge(b"".join(self.tokens[t] for t in left[a:] + right[:b]))

    def _reduce(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            found = self._parts.get(data)
            if found is None:
                if len(self._parts) >= CACHE_ENTRIES:
                    self._parts.clear()
                found = self._parts[data] = self.merge(data)
            return found
        middle = len(data) // 2
        return self.join(self._reduce(data[:middle]), self._reduce(data[middle:]))

    def encode_match(self, data: bytes) -> list[int]:
        """One match of the pattern; a match that is a token stays whole."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else list(self._reduce(data))

    def decode(self, ids) -> bytes:
        """The bytes of the ids, concatenated up the tree."""
        if len(ids) > 65_536:
            middle = len(ids) // 2
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        return b"".join(map(self.tokens.__getitem__, ids))


class _Matches(dict):
    """From a match to its ids as little-endian 32-bit integers; bounded."""

    def __init__(self, bpe: TreeBpe):
        self.bpe = bpe

    def __missing__(self, match: str) -> bytes:
        ids = self.bpe.encode_match(match.encode("utf-8", "surrogatepass"))
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[match] = found
        return found


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TextCodec:
    """Encodes whole texts to packed ids, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.bpe = TreeBpe(ranks)
        self.split = regex.compile(pattern).findall
        self.matches = _Matches(self.bpe)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return self.bpe.decode(memoryview(packed).cast("I")) if packed else b""


DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def encode_column(frame: DataFrame, rank_path: str, pattern: str, column: str = "text", output: str = "token_ids") -> DataFrame:
    """``frame`` with the ids of ``column`` as an array."""

    def compute():
        codec = TextCodec(load_ranks(rank_path), pattern)

        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            texts = rows.column(rows.schema.names.index(column)).to_pylist()
            return [pa.array([memoryview(codec.encode(x)).cast("I").tolist() if x else [] for x in texts], pa.list_(pa.int64()))]

        return batch

    return append_columns(frame, [T.StructField(output, T.ArrayType(T.LongType()))], compute)


def decode_column(frame: DataFrame, rank_path: str, column: str = "token_ids", output: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that an array of ids stands for; null is empty."""

    def compute():
        bpe = TreeBpe(load_ranks(rank_path))

        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            ids = rows.column(rows.schema.names.index(column)).to_pylist()
            return [pa.array([bpe.decode(x or []) for x in ids], pa.binary())]

        return batch

    return append_columns(frame, [T.StructField(output, T.BinaryType())], compute)


def token_digests(frame: DataFrame, rank_path: str, pattern: str, column: str = "text") -> DataFrame:
    """``frame`` with the count and digest of the ids, and the digest of the decoded bytes.

    One map without shuffle; each row stands alone, so no key can be hot.
    """

    def compute():
        codec = TextCodec(load_ranks(rank_path), pattern)

        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            counts, ids, decoded = [], [], []
            for text in rows.column(rows.schema.names.index(column)):
                packed = codec.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed)).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

        return batch

    return append_columns(frame, DIGESTS, compute)
