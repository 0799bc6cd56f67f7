"""Language-model scores by context-tree weighting over bytes.

Tokens are lower-cased words and one end to each text. A token is spelled as its
bytes and a closing mark, each byte as eight binary choices, most significant
bit first. The context of a byte is the ``DEPTH`` bytes before it in its text,
whatever tokens they belong to; a text begins with an opening mark.
Every context of 0 to ``DEPTH`` bytes keeps a
Krichevsky-Trofimov estimate of each binary choice, and context-tree weighting
mixes the estimates of all depths: a node's weighted probability is half its own
estimate and half the product of its children's. The end of a text is the empty
word. A text's probability is the product over its tokens.

1. Texts are dealt to blocks of about ``BLOCK_BYTES``; long ones are cut between
   words. A block keeps its texts, and each of its distinct words and distinct
   (context, byte) keys once, with their counts in training texts, dealt to
   parts by hash. Keys with the same last three context bytes share a part.
2. Each part adds up the counts of all blocks. It weighs depths 3 to ``DEPTH``
   of its trees and gives what they weigh to depth 2. Depths 0 to 2 have at most
   65,536 contexts with 255 nodes each; they are weighed on the driver.
3. Each part mixes all depths for its keys and answers every block, with the
   code length of each of the block's keys and the count of each of its words.
4. Each block adds up the answers along its texts. Code lengths reach it in single
   precision, at every size.

So no text meets the whole model and no task holds it: what a task holds is one
block, or one part, whose number follows ``spark.sql.shuffle.partitions``. What
is learned has no bound but the distinct keys and words of the training texts.

Edge cases: a null text is empty and has the end alone; without training rows
all counts are 0 and the model is uniform; repeated rows, also those of one
doc_id, are scored each and count each; a null doc_id is scored like any other;
a text of any length is read whole; of ``docs`` only
doc_id and text are read, so that no other column can clash; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import give_back, small_batches, utf8, written

DEPTH = 6
#: Contexts of so many bytes at least are weighed in the parts, shorter ones on the driver.
LOWER = 3
CLOSE = 0x0A  # a byte that no word has
FIRST_MARK = 0xF8  # the opening mark: a byte that no UTF-8 text has
BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 1 << 20
#: Bytes that are spelled at once within a processor's cache, and keys that wait to be merged.
CACHED, MERGED = 1 << 18, 1 << 19
#: Parts to a shuffle partition, so that parts of uneven size even out.
PARTS = 2
NODE = 256
# What a row is; texts come after the answers that they need, blocks after the model.
KEY_MODEL, WORD_MODEL, BLOCK_KEYS, BLOCK_WORDS, TEXT, NODES = range(6)

DEALT = "block long, kind int, part int, data binary, counts binary, text binary"
MODEL = "part int, kind int, data binary, counts binary, total long, known long, node long, zeros double, ones double, below double"


def spelled(text: bytes) -> bytes:
    """The opening mark, and each word of a lower-cased text and its end with a closing mark."""
    # Words are runs of bytes other than 0x20 and 0x09 to 0x0D.
    return b"%c%b%c" % (FIRST_MARK, bytes([CLOSE]).join([*text.split(), b""]), CLOSE)


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(lead, part of a spelled text): cut after closing marks; the first ``lead`` bytes are context only."""
    at = 1
    while at < len(text):
        stop = text.find(CLOSE, at + CHUNK_BYTES) + 1 if len(text) - at > CHUNK_BYTES else 0
        stop = stop or len(text)
        lead = min(at, DEPTH)
        yield lead, text[at - lead : stop]
        at = stop


def rolled(data: np.ndarray, out: np.ndarray) -> None:
    """Into ``out`` the key of each byte, from the bytes before it in ``data``; zeros before its start."""
    two = data.astype(np.uint16) << np.uint16(8)
    two[1:] |= data[:-1]
    four = two.astype(np.uint32) << np.uint32(16)
    four[2:] |= two[:-2]
    out[:] = data
    out[1:] |= four[:-1].astype(np.int64) << 24
    out[5:] |= two[:-5].astype(np.int64) << 8


def keys_of(parts: list[tuple[int, bytes]]) -> np.ndarray:
    """A key for each byte of the pieces: its context, the nearest byte first, then the byte; 56 bits."""
    data = np.frombuffer(b"".join(b"%b%b" % (bytes(DEPTH), p) for _, p in parts), np.uint8)
    mark = np.ones(len(data), bool)
    at = 0
    for lead, p in parts:
        mark[at : at + DEPTH + lead] = False
        at += DEPTH + len(p)
    found = np.empty(len(data), np.int64)
    for i in range(0, len(data), CACHED):
        # The first of a stretch lack their context, so each stretch begins earlier.
        stretch = np.empty(min(CACHED, len(data) - i) + min(DEPTH, i), np.int64)
        rolled(data[max(0, i - DEPTH) : i + CACHED], stretch)
        found[i : i + CACHED] = stretch[min(DEPTH, i) :]
    return found[mark]


def chunked(parts: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """The pieces in groups of about ``CHUNK_BYTES``; a long word is cut."""
    held, size = [], 0
    for lead, p in parts:
        at = lead
        while at < len(p):
            stop = min(len(p), at + 2 * CHUNK_BYTES)
            before = lead if at == lead else DEPTH
            held.append((before, p[at - before : stop]))
            size += stop - at
            at = stop
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


class Gathered:
    """Distinct keys with their counts, merged as they come."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if len(self.held) > 2 and self.size > 1.5 * len(self.held[0][0]) + MERGED:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])

    def spell(self, parts: list[tuple[int, bytes]], weight: int) -> None:
        """Adds the keys of pieces, with ``weight`` times their counts."""
        for chunk in chunked(parts):
            keys = keys_of(chunk)
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.add(keys[first], weight * np.diff(np.append(first, len(keys))))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))


class Places:
    """Where each of some distinct keys stands, by hashing with open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.uint64(64 - max(10, int(2 * len(keys)).bit_length()))
        slots = self.slots = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self.start(keys)
        while len(todo):
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            left = slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(slots) - 1)

    def start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each of ``asked``; all are among the keys."""
        at = self.start(asked)
        found = self.slots[at]
        wrong = np.flatnonzero(self.keys[found] != asked)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != asked[wrong]]
        return found


_ZSTD = pa.Codec("zstd")


def packed(numbers: np.ndarray) -> bytes:
    """Integers, byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def packed_words(words: list[bytes]) -> bytes:
    flat = bytes([CLOSE]).join(words)
    return len(flat).to_bytes(8, "little") + _ZSTD.compress(flat, asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    """The words, of which there is at least one; the empty word is one too."""
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).split(bytes([CLOSE]))


# A piece of a text: its row, document (with a mark where that is null), whether it is held out, its lead and its bytes.
Piece = tuple[int, int | None, bool, int, bytes]


def packed_texts(pieces: list[Piece]) -> dict[str, bytes]:
    numbers = np.array([(uid, doc or 0, doc is None, held, lead, len(text)) for uid, doc, held, lead, text in pieces], np.int64)
    flat = b"".join(text for *_, text in pieces)
    return {"data": packed(numbers.T.ravel()), "text": len(flat).to_bytes(8, "little") + _ZSTD.compress(flat, asbytes=True)}


def unpacked_texts(data: bytes, text: bytes) -> Iterator[Piece]:
    flat, at = _ZSTD.decompress(text[8:], int.from_bytes(text[:8], "little"), asbytes=True), 0
    for uid, doc, missing, held, lead, n in unpacked(data).reshape(6, -1).T.tolist():
        yield uid, None if missing else doc, bool(held), lead, flat[at : at + n]
        at += n


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by the last ``LOWER`` bytes of its context."""
    near = (keys >> (8 * (DEPTH + 1 - LOWER))).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def batch_of(schema: str, rows: list[dict]) -> pa.RecordBatch:
    """Rows as an Arrow batch; what a row has no value for is null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def dealt(docs: DataFrame, held_out: Column, parts: int) -> DataFrame:
    """The rows of ``DEALT``: each block's texts, its words and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[Piece] = []
        kept: list[dict] = []
        waiting: dict[bool, list[tuple[int, bytes]]] = {False: [], True: []}
        sizes = {False: 0, True: 0}
        found = Gathered()
        words: Counter = Counter()
        unseen: set[bytes] = set()
        size, number, task = 0, 0, 0

        def spell(held: bool) -> None:
            found.spell(waiting[held], 0 if held else 1)
            waiting[held].clear()
            sizes[held] = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, number, found
            block = (task << 32) | number
            for held in (False, True):
                spell(held)
            yield batch_of(DEALT, [r | {"block": block, "kind": TEXT} for r in [*kept, *([packed_texts(texts)] if texts else [])]])
            keys, counts = found.merged()
            where = part_of(keys, parts)
            order = np.argsort(where, kind="stable")
            keys, counts, where = keys[order], counts[order], where[order]
            edges = [*np.flatnonzero(np.diff(where, prepend=-1)), len(keys)]
            rows = [{"block": block, "kind": BLOCK_KEYS, "part": int(where[i]), "data": packed_keys(keys[i:j]), "counts": packed(counts[i:j])} for i, j in zip(edges, edges[1:], strict=False)]
            by_part: dict[int, list[bytes]] = {}
            for w in words.keys() | unseen:
                by_part.setdefault(crc32(w) % parts, []).append(w)
            rows += [{"block": block, "kind": BLOCK_WORDS, "part": p, "data": packed_words(ws), "counts": packed(np.array([words.get(w, 0) for w in ws], np.int64))} for p, ws in by_part.items()]
            yield batch_of(DEALT, rows)
            for gathered in (texts, kept, words, unseen):
                gathered.clear()
            size, number, found = 0, number + 1, Gathered()
            give_back()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for part, uid, doc, held, text in zip(*columns, utf8(batch.column(3)), strict=True):
                task = part
                whole = spelled(text.lower())
                for lead, piece in pieces(whole):
                    texts.append((uid, doc, held, lead, piece))
                    (unseen if held else words).update(piece[lead:-1].split(bytes([CLOSE])))
                    waiting[held].append((lead, piece))
                    sizes[held] += len(piece)
                    if sizes[held] >= CHUNK_BYTES:
                        spell(held)
                        kept.append(packed_texts(texts))
                        texts.clear()
                    size += len(piece)
                    if size >= BLOCK_BYTES:
                        yield from flush()
        if size:
            yield from flush()

    # Very small input partitions are read together, for blocks of a sensible size.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES)))
    rows = few.select(F.spark_partition_id(), F.monotonically_increasing_id(), F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)))
    return rows.mapInArrow(run, DEALT)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma by Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_SMALL = np.arange(4096, dtype=np.float64)
_SMALL_HALF, _SMALL_ONE = log_gamma(_SMALL + 0.5), log_gamma(_SMALL + 1)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n = n0 + n1
    low = np.minimum(n, len(_SMALL) - 1).astype(np.int64)
    out = _SMALL_HALF[np.minimum(n0, len(_SMALL) - 1).astype(np.int64)] + _SMALL_HALF[np.minimum(n1, len(_SMALL) - 1).astype(np.int64)] - _SMALL_ONE[low]
    big = np.flatnonzero(n >= len(_SMALL))
    out[big] = log_gamma(n0[big] + 0.5) + log_gamma(n1[big] + 0.5) - log_gamma(n[big] + 1)
    return out - np.log(np.pi)


def halved(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted probabilities of nodes with children, in logarithms, and the share of their own estimates."""
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(np.minimum(own - np.log(2) - weighted, 0))


class Level:
    """The distinct (context, byte) pairs of one depth in order, and where those of the next depth belong."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, within: np.ndarray | None = None):
        self.keys, self.n, self.within = keys, n, within

    def above(self, depth: int) -> Level:
        """The level of one byte less of context; ``depth`` is this one's."""
        shorter = (self.keys >> 16 << 8) | (self.keys & 255) if depth else self.keys
        keys, within = np.unique(shorter, return_inverse=True)
        return Level(keys, np.bincount(within, self.n, len(keys)), within)

    def choice(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of the ``k``-th choice: first pair, run of each pair, zeros, ones, and each pair's bit."""
        node = self.keys >> (8 - k)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
        bit = (self.keys >> (7 - k)) & 1
        ones = np.add.reduceat(self.n * bit, first)
        return first, run, np.add.reduceat(self.n, first) - ones, ones, bit


def levels(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of depth ``DEPTH`` down to ``LOWER - 1`` of sorted keys."""
    out = [Level(keys, n.astype(np.float64))]
    for depth in range(DEPTH, LOWER - 1, -1):
        out.append(out[-1].above(depth))
    return out


def node_ids(keys: np.ndarray, k: int) -> np.ndarray:
    """Names of the nodes of the ``k``-th choice of (context, byte) pairs."""
    return (keys >> 8) * NODE + ((1 << k) | ((keys & 255) >> (8 - k)))


def weigh(tree: list[Level], k: int) -> tuple[list[tuple], np.ndarray]:
    """For the ``k``-th choice, bottom up: each level's runs, bits, counts and shares, and the last level's sums from below."""
    seen, below, starts = [], None, None
    for level in tree:
        first, run, zeros, ones, bit = level.choice(k)
        if below is None:
            weighted, share = log_kt(zeros, ones), None
        else:
            under = np.bincount(run[level.within[starts]], below, len(first))
            if level is tree[-1]:
                return seen, under
            weighted, share = halved(log_kt(zeros, ones), under)
        seen.append((level, run, bit, zeros, ones, share))
        below, starts = weighted, first
    raise AssertionError("no level")


def upward(keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """What whole subtrees of depth ``LOWER`` give the nodes of one byte less: counts and weights."""
    tree = levels(keys, n)
    nodes, zeros, ones, below = [], [], [], []
    for k in range(8):
        first, _, z, o, _ = tree[-1].choice(k)
        nodes.append(node_ids(tree[-1].keys[first], k))
        zeros.append(z)
        ones.append(o)
        below.append(weigh(tree, k)[1])
    return {"node": np.concatenate(nodes), "zeros": np.concatenate(zeros), "ones": np.concatenate(ones), "below": np.concatenate(below)}


def code_lengths(keys: np.ndarray, n: np.ndarray, upper: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of each key's mixed probability, over all depths."""
    tree = levels(keys, n)
    total = np.zeros(len(keys))
    for k in range(8):
        top = tree[-1].keys
        at = np.searchsorted(upper["node"], node_ids(top, k))
        told, rest = np.where((top >> (7 - k)) & 1, upper["one"][at], upper["zero"][at]), upper["rest"][at]
        within = tree[-1].within
        for level, run, bit, zeros, ones, share in reversed(weigh(tree, k)[0]):
            told, rest = told[within], rest[within]
            estimate = (np.where(bit, ones[run], zeros[run]) + 0.5) / (zeros + ones + 1)[run]
            if share is None:
                total += np.log10(told + rest * estimate)
            else:
                told, rest, within = told + rest * share[run] * estimate, rest * (1 - share[run]), level.within
    return total


def upper_levels(sums: pa.Table) -> dict[str, np.ndarray]:
    """Depths 0 to ``LOWER - 1`` of nodes (node, zeros, ones, below), told as what each adds to a choice of 0 or 1 and leaves to longer contexts."""
    node = sums.column("node").to_numpy()
    order = np.argsort(node)
    node = node[order]
    zeros, ones, below = (sums.column(c).to_numpy()[order].astype(np.float64) for c in ("zeros", "ones", "below"))
    seen, ids, inverse = [], node, np.arange(len(node))
    for depth in range(LOWER - 1, -1, -1):
        weighted, share = halved(log_kt(zeros, ones), below)
        seen.append((share[inverse], ((zeros + 0.5) / (zeros + ones + 1))[inverse], ((ones + 0.5) / (zeros + ones + 1))[inverse]))
        if depth:
            # The oldest byte of a node's context goes.
            ids, up = np.unique((ids // NODE >> 8) * NODE + ids % NODE, return_inverse=True)
            zeros, ones, below = (np.bincount(up, x, len(ids)).astype(np.float64) for x in (zeros, ones, weighted))
            inverse = up[inverse]
    zero, one, rest = np.zeros(len(node)), np.zeros(len(node)), np.ones(len(node))
    for share, at0, at1 in reversed(seen):
        zero, one, rest = zero + rest * share * at0, one + rest * share * at1, rest * (1 - share)
    return {"node": node, "zero": zero, "one": one, "rest": rest}


def learned(blocks: DataFrame) -> DataFrame:
    """The rows of ``MODEL``: each part's keys and words with their counts, and its sums for nodes of depth ``LOWER - 1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered()
        words: Counter = Counter()
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found
            rows = []
            if found.held:
                keys, counts = found.merged()
                rows.append({"part": now, "kind": KEY_MODEL, "data": packed_keys(keys), "counts": packed(counts)})
                sums = upward(keys, counts)
                n = len(sums["node"])
                columns = {"kind": pa.array([NODES] * n, pa.int32())} | {c: pa.array(v) for c, v in sums.items()}
                empty = batch_of(MODEL, [{}] * n)
                yield pa.RecordBatch.from_arrays([columns.get(f.name, empty.column(i)) for i, f in enumerate(empty.schema)], empty.schema.names)
            if words:
                numbers = np.array(list(words.values()), np.int64)
                rows.append({"part": now, "kind": WORD_MODEL, "data": packed_words(list(words)), "counts": packed(numbers), "total": int(numbers.sum()), "known": int((numbers > 0).sum())})
            found = Gathered()
            words.clear()
            yield batch_of(MODEL, rows)
            give_back()

        for batch in batches:
            for part, kind, data, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield from flush()
                    now = part
                if kind == BLOCK_KEYS:
                    found.add(unpacked_keys(data), unpacked(counts))
                else:
                    for word, n in zip(unpacked_words(data), unpacked(counts).tolist(), strict=True):
                        words[word] += n
        if now is not None:
            yield from flush()

    rows = blocks.where(F.col("kind").isin(BLOCK_KEYS, BLOCK_WORDS)).select("part", "kind", "data", "counts")
    return rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, MODEL)


def answered(blocks: DataFrame, model: DataFrame, upper: dict[str, np.ndarray]) -> DataFrame:
    """(block, kind, part, data, counts): each block's keys with code lengths (single precision) and words with counts in ``counts``."""
    shared = blocks.sparkSession.sparkContext.broadcast(upper)
    schema = "block long, kind int, part int, data binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths = None
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for part, kind, block, data, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == KEY_MODEL:
                    keys = unpacked_keys(data)
                    lengths = code_lengths(keys, unpacked(counts), shared.value)
                elif kind == WORD_MODEL:
                    known = dict(zip(unpacked_words(data), unpacked(counts).tolist(), strict=True))
                elif kind == BLOCK_KEYS:
                    found = lengths[np.searchsorted(keys, unpacked_keys(data))]
                    rows.append({"block": block, "kind": kind, "part": part, "data": data, "counts": found.astype("<f4").tobytes()})
                else:
                    found = np.array([known[w] for w in unpacked_words(data)], np.int64)
                    rows.append({"block": block, "kind": kind, "part": part, "data": data, "counts": packed(found)})
            yield batch_of(schema, rows)

    asked = blocks.where(F.col("kind").isin(BLOCK_KEYS, BLOCK_WORDS)).select("part", "kind", "block", "data")
    told = model.where(F.col("kind").isin(KEY_MODEL, WORD_MODEL)).select("part", "kind", F.lit(None).cast("long").alias("block"), "data", "counts")
    rows = told.unionByName(asked.withColumn("counts", F.lit(None).cast("binary")))
    return rows.repartition("part").sortWithinPartitions("part", "kind", "block").mapInArrow(run, schema)


SUMS = "uid long, doc_id long, held boolean, n_tokens long, n_known long, base double, lp double"


def added(blocks: DataFrame, answers: DataFrame, total: int, known: int) -> DataFrame:
    """The rows of ``SUMS``, one for each piece of a text."""
    base = float(total + 0.5 * (known + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        keys: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        places = spread = None
        words: dict[bytes, float] = {}
        unknown = float(np.log10(0.5 / base))
        waiting: list[Piece] = []

        def flush() -> pa.RecordBatch:
            nonlocal places, spread
            if places is None:
                places, spread = Places(np.concatenate(keys)), np.concatenate(lengths)
                keys.clear()
                lengths.clear()
            sums = np.zeros(len(waiting))
            for i, (*_, lead, piece) in enumerate(waiting):
                if len(piece) - lead > 2 * CHUNK_BYTES:
                    # A word longer than a chunk.
                    sums[i] = sum(float(look(part).sum()) for part in chunked([(lead, piece)]))
            short = [(i, lead, piece) for i, (*_, lead, piece) in enumerate(waiting) if len(piece) - lead <= 2 * CHUNK_BYTES]
            if short:
                each = look([(lead, piece) for _, lead, piece in short])
                ends = np.cumsum([len(piece) - lead for _, lead, piece in short])
                sums[[i for i, _, _ in short]] = np.add.reduceat(each, np.concatenate([[0], ends[:-1]]))
            tokens = [piece[lead:-1].split(bytes([CLOSE])) for *_, lead, piece in waiting]
            numbers = [len(t) for t in tokens]
            logs = np.fromiter((words[w] for t in tokens for w in t), np.float64, sum(numbers))
            starts = np.concatenate([[0], np.cumsum(numbers)[:-1]])
            columns = [pa.array([w[c] for w in waiting], k) for c, k in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_()))]
            columns += [pa.array(numbers, pa.int64()), pa.array(np.add.reduceat((logs > unknown).astype(np.int64), starts)), pa.array(np.add.reduceat(logs, starts)), pa.array(sums)]
            waiting.clear()
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SUMS.split(", ")])

        def look(parts: list[tuple[int, bytes]]) -> np.ndarray:
            return spread[places.find(keys_of(parts))].astype(np.float64)

        for batch in batches:
            for block, kind, data, counts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    places = spread = None
                    words, now = {}, block
                    keys.clear()
                    lengths.clear()
                    give_back()
                if kind == BLOCK_KEYS:
                    keys.append(unpacked_keys(data))
                    lengths.append(np.frombuffer(counts, "<f4"))
                elif kind == BLOCK_WORDS:
                    numbers = unpacked(counts)
                    # Words of one count share one number.
                    logs = {n: float(np.log10((n + 0.5) / base)) for n in np.unique(numbers).tolist()}
                    words.update(zip(unpacked_words(data), map(logs.get, numbers.tolist()), strict=True))
                else:
                    waiting.extend(unpacked_texts(data, text))
                    yield flush()

    texts = blocks.where(F.col("kind") == TEXT).select("block", "kind", "data", F.lit(None).cast("binary").alias("counts"), "text")
    rows = answers.select("block", "kind", "data", "counts", F.lit(None).cast("binary").alias("text")).unionByName(texts)
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, SUMS)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Each document with its counts, its base score and the model's score."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(dealt(docs, held_out, parts), "blocks")
    model = written(learned(blocks), "context-trees")
    counted = model.where(F.col("kind") == WORD_MODEL).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    nodes = model.where(F.col("kind") == NODES).groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    upper = upper_levels(nodes.toArrow())
    sums = added(blocks, answered(blocks, model, upper), counted["n"], counted["v"])
    whole = sums.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lp")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counted["n"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"))
