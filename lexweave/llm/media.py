"""Copies of images by local descriptors, whole, cropped or edited.

1. Each image gives corners at several scales: local maxima of the smaller
   eigenvalue of the gradient's structure. A corner's orientation is that of
   its patch's intensity centroid; its descriptor is ``BITS`` comparisons of
   smoothed pixels at places turned by that orientation.
2. Images with the same corners are one class, which stands for all of them. The
   descriptor is cut into ``TABLES`` keys; corners of an image may share keys, as in a
   repeated texture. Images lie in packed blocks, and every block meets every other:
   for two classes the corners of each that have a shared key are counted there, so
   that no pair of images is shuffled; the work grows with the pairs of a key.
3. Where enough are shared, corners of two images that share a key are compared by
   their whole descriptors, each with each; those within ``HAMMING`` bits meet and vote
   for a similarity's rotation, scale and shift; the best one's inliers are counted.
4. Images with at least ``INLIERS`` agreeing corners are linked; links are closed
   into groups. ``n_links`` counts all images that an image is linked to.

Media are bytes: PGM or PPM (binary, 8 bits), or PNG with 8-bit grey or RGB
samples without interlacing. ``rasterise`` makes such bytes from a page's markup:
every word is a cell of grey texture, every block a new row.

Edge cases: null, empty, broken or featureless media, and those under 8 pixels a
side, have no corners and are their own group; rows of one id are one image with
the corners of all of them, and repeated rows change nothing; a row with a null
id is one image of null id without links; images of any size are read whole; ties
between groups go to the smaller id; only the first two columns are read, so no
other can clash; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import give_back, small_batches, written
from lexweave.llm.components import components

LEVELS, SPACING, STRENGTH = 2, 4, 0.02
BITS, TABLES, ANGLES, RADIUS = 128, 4, 32, 7
VOTES, INLIERS, TOLERANCE = 6, 8, 3.0
#: Bits of a descriptor in which two corners that share a key may differ.
HAMMING = 32
CELL, COLUMNS = 4, 32
#: Images of a key in a block, about, and of a block of corners; pairs that a task holds before it sums them up.
BLOCK, HELD_PAIRS = 1000, 2_000_000
#: Corners of a block, about; pairs of corners whose votes are counted at once.
BLOCK_CORNERS, HELD_VOTES = 250_000, 100_000
_SCALES = 2 * LEVELS - 1

_RANDOM = np.random.default_rng(7)
_TESTS = np.clip(_RANDOM.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS, RADIUS)
_TURN = 2 * np.pi * np.arange(ANGLES) / ANGLES
_COS, _SIN = np.cos(_TURN)[:, None], np.sin(_TURN)[:, None]
_TURN_COS, _TURN_SIN = (np.array([f(2 * np.pi * t / ANGLES) for t in range(ANGLES)]) for f in (np.cos, np.sin))
# Places of both pixels of every test, for every orientation.
_AY, _AX = np.rint(_TESTS[:, 0] * _COS + _TESTS[:, 1] * _SIN).astype(int), np.rint(_TESTS[:, 1] * _COS - _TESTS[:, 0] * _SIN).astype(int)
_BY, _BX = np.rint(_TESTS[:, 2] * _COS + _TESTS[:, 3] * _SIN).astype(int), np.rint(_TESTS[:, 3] * _COS - _TESTS[:, 2] * _SIN).astype(int)
_REACH = int(max(np.abs(x).max() for x in (_AY, _AX, _BY, _BX)))
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = np.argwhere((_GRID**2).sum(0) <= RADIUS**2) - RADIUS


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels of the image, or None if it can't be read."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data)
            width, height, depth = int(head[1]), int(head[2]), 1 if data[1:2] == b"5" else 3
            pixels = np.frombuffer(data, np.uint8, width * height * depth, head.end()).reshape(height, width, depth)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _decode_png(data)
        else:
            return None
        return pixels.mean(2).astype(np.float32) if min(pixels.shape[:2]) >= 8 else None
    except (ValueError, TypeError, zlib.error, IndexError, KeyError):
        return None


def _decode_png(data: bytes) -> np.ndarray:
    at, parts, head = 8, [], b""
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth = {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    if head[8] != 8 or head[12]:
        raise ValueError("only 8-bit samples without interlacing")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height, width * depth), np.uint8)
    before = np.zeros(width * depth, np.int64)
    for y, row in enumerate(rows):
        kind, line = row[0], row[1:].astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                left, up, corner = (line[x - depth] if x >= depth else 0), before[x], (before[x - depth] if x >= depth else 0)
                if kind == 1:
                    line[x] = (line[x] + left) & 255
                elif kind == 3:
                    line[x] = (line[x] + (left + up) // 2) & 255
                else:
                    guess = left + up - corner
                    away = (abs(guess - left), abs(guess - up), abs(guess - corner))
                    line[x] = (line[x] + (left, up, corner)[away.index(min(away))]) & 255
        out[y] = line
        before = line
    pixels = out.reshape(height, width, depth)
    return pixels[:, :, : {1: 1, 2: 1, 3: 3, 4: 3}[depth]]


def rasterise(markup: str | None) -> bytes | None:
    """A page's visible words as a grey image in PGM: a cell to a word, a row or more to a block."""
    if not markup:
        return None
    seen = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", markup)
    rows: list[list[str]] = []
    for block in re.split(r"(?i)</?(?:p|div|li|ul|h[1-6]|br|tr|table|article|nav|title)\b[^>]*>|\n", seen):
        words = re.sub(r"<[^>]*>", " ", block).split()
        rows += [words[i : i + COLUMNS] for i in range(0, len(words), COLUMNS)]
    if not rows:
        return None
    image = np.full((max(8 // CELL, len(rows)), CELL, COLUMNS, CELL), 255, np.uint8)
    textures = np.array([zlib.crc32(w.encode("utf-8", "replace")) for row in rows for w in row], "<u4").view(np.uint8).reshape(-1, 2, 2)
    down = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    along = np.concatenate([np.arange(len(r)) for r in rows])
    image[down, :, along, :] = textures.repeat(CELL // 2, 1).repeat(CELL // 2, 2)
    image = image.reshape(-1, COLUMNS * CELL)
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def _framed(x: np.ndarray, reach: int, value: float) -> np.ndarray:
    out = np.full((x.shape[0] + 2 * reach, x.shape[1] + 2 * reach), value, x.dtype)
    out[reach:-reach, reach:-reach] = x
    return out


def _smooth(x: np.ndarray, times: int = 1) -> np.ndarray:
    """Binomial weights over three pixels each way; the edge repeats."""
    for _ in range(times):
        y = 2 * x
        y[1:] += x[:-1]
        y[:-1] += x[1:]
        y[0] += x[0]
        y[-1] += x[-1]
        x = 2 * y
        x[:, 1:] += y[:, :-1]
        x[:, :-1] += y[:, 1:]
        x[:, 0] += y[:, 0]
        x[:, -1] += y[:, -1]
        x /= 16
    return x


def _largest(x: np.ndarray, reach: int) -> np.ndarray:
    """The largest value in the square around each pixel, by windows that double."""
    width = 2 * reach + 1
    x = _framed(x, reach, -1)
    for axis in (0, 1):
        x, have = x.swapaxes(0, axis), 1
        while have < width:
            step = min(have, width - have)
            x = np.maximum(x[: len(x) - step], x[step:])
            have += step
        x = x.swapaxes(0, axis)
    return x


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y, level, angle) in the image's own pixels, and descriptors as bytes."""
    places, descriptors = [], []
    level_image = image
    for level in range(LEVELS):
        if min(level_image.shape) < 2 * SPACING:
            break
        soft = _smooth(level_image)
        dy, dx = np.gradient(soft)
        xx, yy, xy = _smooth(dx * dx, 2), _smooth(dy * dy, 2), _smooth(dx * dy, 2)
        weak = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
        top = weak.max()
        y, x = np.nonzero((weak >= _largest(weak, SPACING)) & (weak > STRENGTH * top) & (weak > 1e-3))
        if len(y):
            # Beyond the edge there is grey of the image's mean, whatever the crop.
            padded = _framed(soft, _REACH + 1, float(soft.mean()))
            width = padded.shape[1]
            flat, at = padded.ravel(), ((y + _REACH + 1) * width + x + _REACH + 1)[:, None]
            patch = flat.take(at + (_DISC[:, 0] * width + _DISC[:, 1]))
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2((patch * _DISC[:, 0]).sum(1), (patch * _DISC[:, 1]).sum(1))
            turn = np.rint(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES
            first = flat.take(at + (_AY * width + _AX)[turn])
            second = flat.take(at + (_BY * width + _BX)[turn])
            descriptors.append(np.packbits(first < second, axis=1))
            places.append(np.stack([x << level, y << level, np.full(len(x), level), turn], 1))
        height, width = level_image.shape[0] // 2 * 2, level_image.shape[1] // 2 * 2
        level_image = level_image[:height, :width].reshape(height // 2, 2, width // 2, 2).mean((1, 3))
    if not places:
        return np.zeros((0, 4), int), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(descriptors)


def corner_blocks(media: DataFrame, decode=decode_image) -> DataFrame:
    """Blocks of images with corners, of rows (id, list of data): (block, images, sizes, prints, places, keys).

    A block has ``BLOCK`` images or about ``BLOCK_CORNERS`` corners at most, of one
    task. ``sizes`` counts the corners of each image; ``places`` packs x, y, level
    and angle of each into 64 bits, in order; ``keys`` has ``TABLES`` parts of 32
    bits of each descriptor, both compressed; a print is a digest of both.
    """
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            images, sizes, prints, places, keys = zip(*held, strict=True)
            held.clear()
            planes = np.concatenate(places).view(np.uint8).reshape(-1, 8).T
            blobs = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in (planes, np.concatenate(keys))]
            return pa.RecordBatch.from_arrays(
                [pa.array([images], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([prints], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in blobs)],
                ["images", "sizes", "prints", "places", "keys"],
            )

        for batch in batches:
            for image, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pixels = [decode(x.as_py()) for x in rows.values] if image is not None and rows.values is not None else []
                found = [corners(x) for x in pixels if x is not None]
                found = [x for x in found if len(x[0])]
                if not found:
                    continue
                places, descriptors = (np.concatenate(x) for x in zip(*found, strict=True))
                packed = (places[:, 0].astype(np.int64) << 38) | (places[:, 1].astype(np.int64) << 8) | (places[:, 2] << 5) | places[:, 3]
                order = np.argsort(packed)
                packed, descriptors = packed[order], descriptors[order]
                held.append((image, len(packed), hashlib.blake2b(packed.tobytes() + descriptors.tobytes(), digest_size=16).hexdigest(), packed, descriptors))
                if len(held) >= most or sum(x[1] for x in held) >= BLOCK_CORNERS:
                    yield flush()
        if held:
            yield flush()

    blocks = media.mapInArrow(run, "images array<long>, sizes array<long>, prints array<string>, places binary, keys binary")
    return blocks.select(F.monotonically_increasing_id().alias("block"), "*")


def keyed(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all corners with their table's number, in order, and the corner of each."""
    parts = (np.frombuffer(keys, "<u4").reshape(-1, TABLES).astype(np.int64) | (np.arange(TABLES) << 32)).ravel()
    order = np.argsort(parts, kind="stable")
    return parts[order], order // TABLES


def key_table(found: DataFrame) -> DataFrame:
    """(key, image, corners) for each key of each row (image, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [np.unique(keyed(k)[0], return_counts=True) for k in batch.column(1).to_pylist()]
            images = np.repeat(batch.column(0).to_numpy(), [len(x) for x, _ in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in lists])), pa.array(images), pa.array(np.concatenate([n for _, n in lists]).astype(np.int32))], ["key", "image", "corners"])

    # Dealt by the key alone, they are grouped, counted and paired without another shuffle.
    return found.select("image", "keys").mapInArrow(run, "key long, image long, corners int").repartition("key").groupBy("key", "image").agg(F.sum("corners").cast("int").alias("corners"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a < b: how many corners of each of two images have a key that both have; rows (key, image, corners).

    The counts of all pairs as one table, which ``agreeing`` takes within two blocks.
    A corner counts for each such key. Keys of one image go no further. Images of a key that more than ``BLOCK``
    have are dealt to blocks, and every block meets every other, so no task holds
    all pairs of a key.
    """
    rows = F.count("*").over(Window.partitionBy("key"))
    met = keys.withColumn("rows", rows).where(F.col("rows") > 1).withColumn("blocks", F.ceil(F.col("rows") / BLOCK))
    own = F.struct("image", "corners")
    few = met.where("blocks = 1").groupBy("key").agg(F.collect_list(own).alias("ones")).select("ones", F.array().cast("array<struct<image:bigint,corners:int>>").alias("others"))
    dealt = met.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("image"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    cells = dealt.select("key", "image", "corners", "block", low, high).repartition("key", "low", "high").groupBy("key", "low", "high").agg(
        F.collect_list(F.when(F.col("block") == F.col("low"), own)).alias("ones"),
        F.collect_list(F.when(F.col("block") != F.col("low"), own)).alias("others"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            x, y, m, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            turned = x > y
            x, y, m, n = np.where(turned, y, x), np.where(turned, x, y), np.where(turned, n, m), np.where(turned, m, n)
            ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            x, y = at[: len(x)], at[len(x) :]
            apart = x != y
            code, place = np.unique((x * len(ids) + y)[apart], return_inverse=True)
            sums = [np.bincount(place, c[apart], len(code)).astype(np.int64) for c in (m, n)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[code // len(ids)], ids[code % len(ids)], *sums)], ["a", "b", "n_a", "n_b"])

        for batch in batches:
            for ones, others in zip(batch.column(0), batch.column(1), strict=True):
                (x, m), (y, n) = ((c.values.field("image").to_numpy(), c.values.field("corners").to_numpy()) for c in (ones, others))
                if len(y):
                    i, j = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
                else:
                    (i, j), y, n = np.triu_indices(len(x), 1), x, m
                held.append((x[i], y[j], m[i], n[j]))
                size += len(i)
                if size > HELD_PAIRS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    many = cells.where("low <> high or size(ones) > 1").where("low = high or size(others) > 0").where("size(ones) > 0")
    met = few.unionByName(many.select("ones", "others"))
    counted = met.select("ones", "others").mapInArrow(run, "a long, b long, n_a long, n_b long")
    return counted.groupBy("a", "b").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def meetings(first: list[tuple[bytes, bytes]], second: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The distinct pairs of places of two images' corners that share a key and differ in at most ``HAMMING`` bits.

    An image is its rows' places and keys; the keys of a corner together are its
    descriptor. Candidate pairs are looked at in parts of ``HELD_PAIRS``.
    """

    def read(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, places, bits = [], [], []
        for at, blob in rows:
            found, corner = keyed(blob)
            keys.append(found)
            places.append(np.frombuffer(at, np.int64)[corner])
            bits.append(np.frombuffer(blob, "<u4").reshape(-1, TABLES)[corner])
        return np.concatenate(keys), np.concatenate(places), np.concatenate(bits)

    (k1, p1, b1), (k2, p2, b2) = read(first), read(second)
    order = np.argsort(k2, kind="stable")
    k2, p2, b2 = k2[order], p2[order], b2[order]
    low, high = np.searchsorted(k2, k1), np.searchsorted(k2, k1, "right")
    n = high - low
    ends = np.cumsum(n)
    found, begin = np.zeros((0, 2), np.int64), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HELD_PAIRS, "right")))
        own = n[begin:end]
        left = np.repeat(np.arange(begin, end), own)
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[begin:end], own)
        near = np.bitwise_count(b1[left] ^ b2[at]).sum(1) <= HAMMING
        found = np.unique(np.concatenate([found, np.stack([p1[left[near]], p2[at[near]]], 1)]), axis=0)
        begin = end
    return found


class Squares:
    """Shifts of several kinds in cells of ``TOLERANCE``, and squares that reach as far around each cell with shifts.

    A square reaches into the eight cells beside it, so that their counts together bound what it holds.
    """

    def __init__(self, kind: np.ndarray, sx: np.ndarray, sy: np.ndarray):
        cx, cy = (np.rint(c / TOLERANCE).astype(np.int64) for c in (sx, sy))
        self.sx, self.sy, self.left, self.top = sx, sy, int(cx.min()) - 1, int(cy.min()) - 1
        self.wide, self.high = int(cx.max()) - self.left + 2, int(cy.max()) - self.top + 2
        code = (kind * self.wide + cx - self.left) * self.high + cy - self.top
        self.order = np.argsort(code)
        self.code = code[self.order]
        self.cells = self.code[np.concatenate([[True], self.code[1:] != self.code[:-1]])]
        self.bounds = sum(np.searchsorted(self.code, self.cells + c + 1, "right") - np.searchsorted(self.code, self.cells + c - 1) for c in (-self.high, 0, self.high))

    def kinds(self, cells: np.ndarray) -> np.ndarray:
        return cells // self.high // self.wide

    def inside(self, cell: int) -> np.ndarray:
        """The places of the shifts that the square around a cell holds."""
        rows = np.concatenate([self.order[np.searchsorted(self.code, cell + c - 1) : np.searchsorted(self.code, cell + c + 1, "right")] for c in (-self.high, 0, self.high)])
        x, y = (cell // self.high % self.wide + self.left) * TOLERANCE, (cell % self.high + self.top) * TOLERANCE
        return rows[(np.abs(self.sx[rows] - x) <= TOLERANCE) & (np.abs(self.sy[rows] - y) <= TOLERANCE)]


def consensus(first: np.ndarray, second: np.ndarray, best: int = 0) -> int:
    """The most corners that one similarity maps from one image onto the other, or ``best`` if those are no more; rows of packed places."""
    x1, y1, l1, t1 = first >> 38, (first >> 8) & 0x3FFFFFFF, (first >> 5) & 7, first & 31
    x2, y2, l2, t2 = second >> 38, (second >> 8) & 0x3FFFFFFF, (second >> 5) & 7, second & 31
    turn, scale = (t2 - t1) % ANGLES, l2 - l1
    for s in np.unique(scale):
        for t in np.unique(turn[scale == s]):
            near = (scale == s) & (np.minimum((turn - t) % ANGLES, (t - turn) % ANGLES) <= 1)
            if near.sum() <= best:
                continue
            cos, sin, k = _TURN_COS[t], _TURN_SIN[t], 2.0**s
            sx = (x2 - k * (cos * x1 - sin * y1))[near]
            sy = (y2 - k * (sin * x1 + cos * y1))[near]
            one, two = first[near], second[near]
            squares = Squares(np.zeros(len(sx), np.int64), sx, sy)
            for i in np.argsort(-squares.bounds, kind="stable"):
                if squares.bounds[i] <= best:
                    break
                inside = squares.inside(int(squares.cells[i]))
                if len(inside) > best:
                    best = max(best, min(len(np.unique(one[inside])), len(np.unique(two[inside]))))
    return best


class Block:
    """Images with their corners: the image, place and descriptor of each corner, by image."""

    def __init__(self, ids: np.ndarray, twins: np.ndarray, sizes: np.ndarray, places: np.ndarray, keys: np.ndarray):
        self.ids, self.twins, self.sizes, self.places, self.keys = ids, twins, sizes, places, keys
        self.image = np.repeat(np.arange(len(ids)), sizes)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}

    @classmethod
    def read(cls, row: dict) -> Block:
        """Of a row of ``corner_blocks``, without the images at the places ``skip``; those at ``twins`` stand for several."""
        sizes = np.array(row["sizes"], np.int64)
        total = int(sizes.sum())
        places = np.frombuffer(pa.decompress(row["places"], 8 * total, "zstd"), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
        keys = np.frombuffer(pa.decompress(row["keys"], total * BITS // 8, "zstd"), "<u4").reshape(-1, TABLES)
        kept, twins = np.ones(len(sizes), bool), np.zeros(len(sizes), bool)
        kept[row["skip"] or []], twins[row["twins"] or []] = False, True
        return cls(np.array(row["images"], np.int64), twins, sizes, places, keys).part(kept)

    def part(self, kept: np.ndarray) -> Block:
        if kept.all():
            return self
        corners = kept[self.image]
        return Block(self.ids[kept], self.twins[kept], self.sizes[kept], self.places[corners], self.keys[corners])

    def halves(self) -> tuple[Block, Block]:
        first = np.arange(len(self.ids)) < len(self.ids) // 2
        return self.part(first), self.part(~first)

    def runs(self, table: int) -> tuple[np.ndarray, ...]:
        """The distinct keys with the first and number of their images; of each key and image the image, first and number of corners; the corners."""
        if table not in self.tables:
            packed = np.sort((self.keys[:, table].astype(np.uint64) << np.uint64(32)) | np.arange(len(self.keys), dtype=np.uint64))
            corner, key = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), (packed >> np.uint64(32)).astype(np.uint32)
            image = self.image[corner]
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (image[1:] != image[:-1])]))
            key = key[begin]
            group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.tables[table] = key[group], group, np.diff(group, append=len(key)), image[begin], begin, np.diff(begin, append=len(corner)), corner
        return self.tables[table]


def _each(m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of the first ``m`` with each of the first ``n``, row by row: the row and both numbers."""
    row = np.repeat(np.arange(len(m)), m * n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(m * n) - m * n, m * n)
    return row, at // n[row], at % n[row]


def agreeing(one: Block, two: Block) -> list[tuple[int, int]]:
    """Pairs of images of two blocks, or of a block with itself, with ``INLIERS`` agreeing corners at least.

    Images with many common keys are halved until the pairs of a part are few.
    An image meets itself if it stands for several.
    """
    same = one is two
    if not len(one.ids) or not len(two.ids):
        return []
    tables, met = [], 0
    for table in range(TABLES):
        a = one.runs(table)
        b = a if same else two.runs(table)
        (ka, ga, la), (kb, gb, lb) = a[:3], b[:3]
        y = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
        x = np.flatnonzero(kb[y] == ka)
        y = y[x]
        tables.append((a[3:], b[3:], ga[x], la[x], gb[y], lb[y]))
        met += int((la[x] * lb[y]).sum())
    if max(met, len(one.ids) * len(two.ids)) > 2 * HELD_PAIRS and max(len(one.ids), len(two.ids)) > 1:
        del tables, a, b
        if same:
            first, second = one.halves()
            return agreeing(first, first) + agreeing(first, second) + agreeing(second, second)
        if len(one.ids) >= len(two.ids):
            return [x for half in one.halves() for x in agreeing(half, two)]
        return [x for half in two.halves() for x in agreeing(one, half)]

    # So many corners can't agree where fewer of either image have a shared key.
    size = len(one.ids) * len(two.ids)
    runs = []
    for table, (a, b, ga, la, gb, lb) in enumerate(tables):
        row, i, j = _each(la, lb)
        i, j = i + ga[row], j + gb[row]
        if same:
            kept = (a[0][i] < b[0][j]) | ((a[0][i] == b[0][j]) & one.twins[a[0][i]])
            i, j = i[kept], j[kept]
        # Corners of all tables lie one after another.
        runs.append((a[0][i] * len(two.ids) + b[0][j], a[1][i] + table * len(one.keys), a[2][i], b[1][j] + table * len(two.keys), b[2][j]))
    first, second = (np.concatenate([x[side][3] for x in tables]) for side in (0, 1))
    code, i, m, j, n = (np.concatenate(c) for c in zip(*runs, strict=True))
    del tables, runs
    for side in (0, 1):
        kept = (np.bincount(code, (m, n)[side], size) >= INLIERS)[code]
        code, i, m, j, n = (c[kept] for c in (code, i, m, j, n))
    order = np.argsort(code, kind="stable")
    pairs, pair = np.unique(code[order], return_inverse=True)
    i, m, j, n = (c[order] for c in (i, m, j, n))
    votes = np.bincount(pair, m * n, len(pairs)).astype(np.int64)

    ends, begin, found = np.cumsum(votes), 0, []
    while begin < len(pairs):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HELD_VOTES, "right")))
        at = slice(*np.searchsorted(pair, [begin, end]))
        part = (pair[at] - begin, i[at], m[at], j[at], n[at], first, second)
        if votes[begin] <= HELD_VOTES:
            found += [begin + int(p) for p in agreed(*_votes(one, two, part), end - begin)]
        elif _agree_in_parts(one, two, part):
            found.append(begin)
        begin = end
    ids = [(int(one.ids[pairs[p] // len(two.ids)]), int(two.ids[pairs[p] % len(two.ids)])) for p in found]
    return [(min(x), max(x)) for x in ids]


def _votes(one: Block, two: Block, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair and both places of all corners that share a key and differ in few bits, each two corners in the first table of a shared key."""
    pair, i, m, j, n, first, second = rows
    row, x, y = _each(m, n)
    x, y = first[i[row] + x], second[j[row] + y]
    bits = one.keys[x] ^ two.keys[y]
    halves = np.bitwise_count(bits.view(np.uint64))
    kept = (halves[:, 0] + halves[:, 1] <= HAMMING) & ((bits == 0).argmax(1) == (i // max(1, len(one.keys)))[row])
    return pair[row[kept]], one.places[x[kept]], two.places[y[kept]]


def _agree_in_parts(one: Block, two: Block, rows: tuple[np.ndarray, ...]) -> bool:
    """Whether two images agree whose repeated textures meet very often, by parts of ``HELD_VOTES``, about.

    A part may show it. Else the votes of each scale and turn are counted together.
    """
    pair, *own, first, second = rows
    for begin, number, corner in ((own[0], own[1], first), (own[2], own[3], second)):
        row, at, _ = _each(number, np.ones(len(number), np.int64))
        if len(np.unique(corner[begin[row] + at])) < INLIERS:
            return False

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, m, j, n = own
        step = np.maximum(1, HELD_VOTES // n)
        row, piece, _ = _each(-(-m // step), np.ones(len(m), np.int64))
        begin, step = piece * step[row], step[row]
        i, m, j, n = i[row] + begin, np.minimum(m[row] - begin, step), j[row], n[row]
        for at in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(m * n) // HELD_VOTES)) + 1):
            yield _votes(one, two, (pair[row][at], i[at], m[at], j[at], n[at], first, second))[1:]

    kind = lambda here, there: (((there >> 5) & 7) - ((here >> 5) & 7) + LEVELS - 1) * ANGLES + ((there & 31) - (here & 31)) % ANGLES
    number = np.zeros(_SCALES * ANGLES, np.int64)
    for here, there in parts():
        if len(agreed(np.zeros(len(here), np.int64), here, there, 1)):
            return True
        number += np.bincount(kind(here, there), minlength=len(number))
    number = number.reshape(-1, ANGLES)
    for scale, turn in np.argwhere((number + np.roll(number, 1, 1) + np.roll(number, -1, 1) >= INLIERS) & (number > 0)):
        near = [scale * ANGLES + (turn + step) % ANGLES for step in (-1, 0, 1)]
        kept = [(here[at], there[at]) for here, there in parts() for at in [np.isin(kind(here, there), near)]]
        if consensus(*(np.concatenate(c) for c in zip(*kept, strict=True)), INLIERS - 1) >= INLIERS:
            return True
    return False


def agreed(pair: np.ndarray, first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` pairs of images have ``INLIERS`` corners at least that agree, as ``consensus`` counts; rows of votes.

    All pairs are counted at once: votes of a turn and scale by cells, then by
    the square around each cell. Where the fullest square doesn't decide,
    ``consensus`` does.
    """
    turn, scale = ((second & 31) - (first & 31)) % ANGLES, ((second >> 5) & 7) - ((first >> 5) & 7)
    group = pair * _SCALES + scale + LEVELS - 1
    number = np.bincount(group * ANGLES + turn, minlength=n * _SCALES * ANGLES).reshape(-1, ANGLES)
    enough = (number + np.roll(number, 1, 1) + np.roll(number, -1, 1) >= INLIERS) & (number > 0)
    some = (enough | np.roll(enough, 1, 1) | np.roll(enough, -1, 1))[group, turn]
    pair, first, second, turn, scale, group = (c[some] for c in (pair, first, second, turn, scale, group))
    x1, y1, x2, y2 = first >> 38, (first >> 8) & 0x3FFFFFFF, second >> 38, (second >> 8) & 0x3FFFFFFF
    parts = []
    for step in (-1, 0, 1):
        t = (turn + step) % ANGLES
        at = np.flatnonzero(enough[group, t])
        cos, sin, k = _TURN_COS[t[at]], _TURN_SIN[t[at]], 2.0 ** scale[at]
        sx = x2[at] - k * (cos * x1[at] - sin * y1[at])
        sy = y2[at] - k * (sin * x1[at] + cos * y1[at])
        parts.append((at, group[at] * ANGLES + t[at], sx, sy))
    at, kind, sx, sy = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not len(at):
        return at
    kinds, kind = np.unique(kind, return_inverse=True)
    squares = Squares(kind, sx, sy)
    hopeful = np.flatnonzero(squares.bounds >= INLIERS)
    owner = kinds[squares.kinds(squares.cells[hopeful])] // ANGLES // _SCALES
    fullest = np.lexsort((-squares.bounds[hopeful], owner))
    fullest = fullest[np.diff(owner[fullest], prepend=-1) > 0]
    found, by_pair = [], None
    for cell, p in zip(squares.cells[hopeful[fullest]].tolist(), owner[fullest].tolist(), strict=True):
        inside = at[squares.inside(cell)]
        if min(len(np.unique(first[inside])), len(np.unique(second[inside]))) >= INLIERS:
            found.append(p)
            continue
        if by_pair is None:
            by_pair = np.argsort(pair, kind="stable")
            sorted_pair = pair[by_pair]
        own = by_pair[slice(*np.searchsorted(sorted_pair, [p, p + 1]))]
        if consensus(first[own], second[own], INLIERS - 1) >= INLIERS:
            found.append(p)
    return np.array(found, np.int64)


def image_groups(media: DataFrame, decode=decode_image) -> DataFrame:
    """(id, n_corners, n_links, group_id) for each id of rows (id, data)."""
    small_batches(media.sparkSession)
    ids = media.select(F.col(media.columns[0]).cast("long").alias("id"), F.col(media.columns[1]).alias("data"))
    blocks = written(corner_blocks(ids.select("id", F.array("data")), decode), "corners")
    listed = lambda of: of.select("block", F.posexplode(F.arrays_zip("images", "sizes", "prints")).alias("at", "x")).select("block", "at", F.col("x.images").alias("image"), F.col("x.sizes").alias("n"), F.col("x.prints").alias("print"))
    entries = listed(blocks)
    prints = entries.groupBy("image").agg(F.max("n").alias("n_corners"), F.array_sort(F.collect_set("print")).alias("prints"), F.min(F.struct("block", "at")).alias("first"))
    named = prints.join(prints.groupBy("prints").agg(F.min("image").alias("rep"), F.count("*").alias("size")), "prints")
    images = written(named.select("image", "n_corners", "rep", "size", "first", F.size("prints").alias("rows")), "images")
    classes = images.where("image = rep").select("image", "size")

    def marked(of: DataFrame, kept) -> DataFrame:
        """The blocks with the places of images that take no part there, and of those that stand for several."""
        marks = listed(of).join(images.select("image", "rep", "size", "first", "rows"), "image").withColumn("kept", kept).where("not kept or size > 1")
        marks = written(marks.groupBy("block").agg(F.collect_list(F.expr("case when not kept then at end")).alias("skip"), F.collect_list(F.expr("case when kept then at end")).alias("twins")), "marks")
        return of.drop("prints").join(marks, "block", "left")

    whole = marked(blocks, F.expr("image = rep and rows = 1 and first.block = block and first.at = at"))
    several = images.where("image = rep and rows > 1").select(F.col("image").alias("id"))
    if several.take(1):
        # Images of several rows have the corners of all of them, and stand in blocks of their own.
        joined = written(corner_blocks(ids.join(several, "id", "left_semi").groupBy("id").agg(F.collect_list("data").alias("data")), decode).withColumn("block", -1 - F.col("block")), "corners-joined")
        whole = whole.unionByName(marked(joined, F.lit(True)))

    # Every block meets every other and itself without a shuffle: a task reads both.
    sides = [whole.select(*(F.col(c).alias(f"{c}_{side}") for c in whole.columns)) for side in "ab"]
    met = sides[0].hint("shuffle_replicate_nl").join(sides[1], F.col("block_a") <= F.col("block_b"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, one = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                read = lambda side: Block.read({c: value(f"{c}_{side}") for c in ("images", "sizes", "places", "keys", "skip", "twins")})  # noqa: B023, E731
                if block != value("block_a"):
                    block, one = value("block_a"), read("a")
                two = one if block == value("block_b") else read("b")
                found = agreeing(one, two)
                give_back()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    links = written(met.mapInArrow(agree, "a long, b long"), "image-links")
    groups = components(links, "image-groups").select(F.col("node").alias("rep"), "label")
    ends = links.select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = ends.join(classes.withColumnRenamed("image", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum(F.col("size") - (F.col("a") == F.col("b")).cast("long")).alias("n_links"))
    linked = images.join(degrees, "rep", "left").join(groups, "rep", "left")
    linked = linked.select(F.col("image").alias("id"), "n_corners", "n_links", F.when(F.col("n_links").isNotNull(), F.coalesce("label", "rep")).alias("label"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.select("id").distinct().join(linked, "id", "left").select("id", zero("n_corners"), zero("n_links"), F.coalesce("label", "id").alias("group_id"))
