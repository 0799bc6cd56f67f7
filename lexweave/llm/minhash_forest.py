"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each text becomes the set of its distinct word shingles as 64-bit hashes,
   with a signature of ``TREES * DEPTH`` minima. Documents with equal sets are
   one class, named by 64 bits of the set's digest.
2. Every tree has an order of all classes: by its own first minima, then through
   those of the other trees, to a depth of 16. A region is a prefix of
   ``LEAST_DEPTH``. A range sort deals the order out evenly, whatever region is
   crowded; a scan compares each class with up to ``REACH`` before it in its
   region, which are those with the longest common prefixes, also across the
   borders of the parts. So the depth adapts: a sparse region is compared whole at
   ``LEAST_DEPTH``, in a crowded one the neighbours agree to a greater depth. All
   candidates by estimated similarity connect into clusters.
3. Each class and its nearest candidate are confirmed on full sets; these links
   are near all that a crowd of copies needs. In clusters that they leave in
   parts, each class outside the largest part meets all others of the cluster:
   those whose estimate is within five deviations of the threshold are confirmed,
   strongest first, except pairs that are connected already. Large clusters are
   cut into blocks.
4. Confirmed links, and those between the sets of one doc_id, are closed into
   components, named by their smallest doc_id.

Recall: a pair at the threshold shares a region in at least one tree with
probability 1 - (1 - 0.8**4)**20 > 0.9999.

Edge cases: a text that is null or has no words has an empty set and links with
nothing; with fewer words than a shingle the whole sequence is the one shingle;
rows with equal doc_id are one document for the links and each get its
component; a null doc_id links with nothing; repeated rows and sets change no
component; a text of any length is read whole; no rows give no rows; only doc_id
and text are read, so that no other column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import small_batches, utf8, written
from lexweave.llm.components import components

SIMILARITY = (80, 100)  # at least 80 / 100
TREES, DEPTH, LEAST_DEPTH, FURTHER = 20, 5, 4, 12
REACH = 256
#: Estimates under these are more than four, or five, deviations below the threshold.
CANDIDATE, CONFIRM = 0.62, 0.58
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 2_000_000
CHUNK_BYTES = 1 << 20
#: Ids (8 bytes each) of clustered documents that are broadcast to pick their texts; more meet them by a shuffle.
BROADCAST_IDS = 1_000_000

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_FLIPS = _RANDOM.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, at least ``n`` of each."""
    held = getattr(_powers, "held", None)
    if held is None or len(held[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        held = _powers.held = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, inverse))
    return held


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each lower-cased word of ``text``, in order; long texts are cut between words."""
    if len(text) > 2 * CHUNK_BYTES:
        parts, at = [], 0
        while at < len(text):
            stop = at + CHUNK_BYTES
            while stop < len(text) and not _SPACE[text[stop]]:
                stop += 1
            parts.append(word_hashes_of(text[at:stop]))
            at = stop
        return np.concatenate(parts)
    return word_hashes_of(text)


def word_hashes_of(text: bytes) -> np.ndarray:
    data = _LOWER[np.frombuffer(text, np.uint8)]
    gap = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # A polynomial in an odd base; a word's part of the running sum is divided by the power at its start.
    powers, back = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers[: len(data)])])
    return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = []
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) < CHUNK_BYTES):
            held += len(texts[stop]) + 1
            stop += 1
        part = texts[at:stop]
        # Texts are hashed together; a word never spans two of them.
        hashes = word_hashes(b" ".join(part))
        counts = [len(x.split()) for x in part]
        ends = np.cumsum(counts)
        for end, count in zip(ends, counts, strict=True):
            words = hashes[end - count : end]
            if count >= n:
                total = np.zeros(count - n + 1, np.uint64)
                for k in range(n):
                    total += words[k : count - n + 1 + k] * _PLACE[k]
                found.append(np.unique(_mix(total)))
            elif count:
                total = (words * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)
                found.append(_mix(np.array([total], np.uint64)))
            else:
                found.append(np.zeros(0, np.uint64))
        at = stop
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set under flips and multiply-shift hashing; sets must not be empty."""
    out = np.zeros((len(sets), len(_MULTIPLIERS)), np.uint32)
    at = 0
    while at < len(sets):
        stop, held = at, 0
        while stop < len(sets) and (stop == at or held + len(sets[stop]) < 60_000):
            held += len(sets[stop])
            stop += 1
        values = np.concatenate(sets[at:stop])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:stop]])[:-1]])
        for k, (flip, multiplier) in enumerate(zip(_FLIPS, _MULTIPLIERS, strict=True)):
            out[at:stop, k] = np.minimum.reduceat((((values ^ flip) * multiplier) >> np.uint64(32)).astype(np.uint32), starts)
        at = stop
    return out


def print_of(shingles: np.ndarray) -> tuple[bytes, int]:
    """The digest of a set, and the name of its class."""
    found = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return found, int.from_bytes(found[:8], "little", signed=True)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_shingles, fp, rep, sig); fp, rep and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(utf8(batch.column(1)), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            prints: list = [None] * len(sets)
            reps: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            for i, sig in zip(full, signatures([sets[i] for i in full]) if full else (), strict=True):
                prints[i], reps[i] = print_of(sets[i])
                sigs[i] = sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(reps, pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "fp", "rep", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, rep long, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """(region, tree, rep): a row for each class and tree; a region is a tree's prefix of least depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = batch.column(0)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(reps), TREES * DEPTH).astype(np.uint64)
            for tree in range(TREES):
                region = np.full(len(reps), tree, np.uint64)
                for d in range(LEAST_DEPTH):
                    region = _mix(region * _PLACE[d] + sig[:, (tree * DEPTH + d) % (TREES * DEPTH)])
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(np.full(len(reps), tree, np.int32)), reps], ["region", "tree", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "region long, tree int, rep long")


ORDERED = "region long, rest binary, rep long, sig binary"


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (region, tree, rep, sig) with the place of each in its tree's order.

    A tree's order runs through all minima from its own first; what follows the
    region's goes by ``FURTHER`` of them, 16 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(n, TREES * DEPTH)
            at = (batch.column(1).to_numpy().astype(np.int64)[:, None] * DEPTH + LEAST_DEPTH + np.arange(FURTHER)) % (TREES * DEPTH)
            flat = (np.take_along_axis(sig, at, 1) >> np.uint32(16)).astype(">u2").tobytes()
            rest = pa.array([flat[2 * FURTHER * i : 2 * FURTHER * (i + 1)] for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), rest, batch.column(2), batch.column(3)], ["region", "rest", "rep", "sig"])

    return rows.select("region", "tree", "rep", "sig").mapInArrow(run, ORDERED)


class Scan:
    """Connects sorted rows (region, rest, rep, sig) with up to ``REACH`` rows before each in its region."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.best: dict[int, tuple[float, int]] = {}
        self.tail: tuple | None = None

    def root(self, x: int) -> int:
        parent = self.parent
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    def feed(self, region: np.ndarray, reps: np.ndarray, sig: np.ndarray) -> None:
        old = 0
        if self.tail is not None:
            old = len(self.tail[0])
            region, reps, sig = np.concatenate([self.tail[0], region]), np.concatenate([self.tail[1], reps]), np.concatenate([self.tail[2], sig])
        rows = np.arange(max(old, 1), len(reps))
        for shift in range(1, REACH + 1):
            rows = rows[rows >= shift]
            rows = rows[region[rows] == region[rows - shift]]
            if not len(rows):
                break
            estimate = (sig[rows] == sig[rows - shift]).mean(1)
            near = estimate >= CANDIDATE
            at = rows[near]
            for x, y, e in zip(reps[at].tolist(), reps[at - shift].tolist(), estimate[near].tolist(), strict=True):
                low, high = (x, y) if x < y else (y, x)
                if (found := self.best.get(high)) is None or (e, -low) > (found[0], -found[1]):
                    self.best[high] = (e, low)
                i, j = self.root(x), self.root(y)
                if i != j:
                    self.parent[max(i, j)] = min(i, j)
        self.tail = (region[-REACH:], reps[-REACH:], sig[-REACH:])

    def stars(self) -> list[pa.Array]:
        """Each connected rep with the least that it is connected with, its nearest smaller candidate and the estimate of that."""
        found = [(x, r, *self.best.get(x, (0.0, r))) for x in list(self.parent) if (r := self.root(x)) != x]
        columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
        return [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[2], pa.float64())]


def _columns(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(batch.column(first + 3).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
    return batch.column(first).to_numpy(), batch.column(first + 2).to_numpy(), sig


STARS = "node long, root long, partner long, estimate double"
SCANNED = f"{STARS}, border long, {ORDERED}"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``STARS`` of a sorted part of the forest, and the rows at its borders.

    A region may go on in the next part: the last rows of a part and the first
    of the next, up to ``REACH`` each and of one region, meet once more.
    """
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    found, head, tail, rows = Scan(), [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        found.feed(*_columns(batch, 0))
        if rows < REACH:
            head.append(batch.slice(0, REACH - rows))
        rows += batch.num_rows
        tail.append(batch)
        while sum(b.num_rows for b in tail) - tail[0].num_rows >= REACH:
            tail.pop(0)
    names = [f.split()[0] for f in SCANNED.split(", ")]
    stars = found.stars()
    yield pa.RecordBatch.from_arrays([*stars, *(pa.nulls(len(stars[0]), k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names)
    for border, batches_, of in ((part - 1, head, 0), (part, tail, -1)):
        if not batches_:
            continue
        table = pa.Table.from_batches(batches_)
        table = table.slice(max(0, table.num_rows - REACH)) if of else table
        region = table.column(0).to_numpy()
        table = table.filter(pa.array(region == region[of]))
        for batch in table.to_batches():
            n = batch.num_rows
            blank = [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(np.full(n, border)), *batch.columns], names)


def scan_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``STARS`` of rows (border, region, rest, rep, sig), sorted."""
    found, now = Scan(), None
    for batch in batches:
        border = batch.column(0).to_numpy()
        region, reps, sig = _columns(batch, 1) if batch.num_rows else ((),) * 3
        edges = [*np.flatnonzero(np.diff(border, prepend=border[0] - 1)), len(border)] if len(border) else []
        for i, j in zip(edges, edges[1:], strict=False):
            if border[i] != now:
                now, found.tail = border[i], None
            found.feed(region[i:j], reps[i:j], sig[i:j])
    yield pa.RecordBatch.from_arrays(found.stars(), [f.split()[0] for f in STARS.split(", ")])


def candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect what any part of the forest of (region, tree, rep, sig) connects, and near pairs (a, b).

    Each part gives stars, so a node has a root for each part that it is in; it
    keeps its least root, to which its other roots are joined. A crowd then
    costs an edge a node, and few more, not one for each of its trees. The near
    pairs are each node's nearest candidate of a smaller name.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["region", "rest", "rep"]
    scanned = written(ordered(rows).repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(scan, SCANNED), "scanned")
    borders = scanned.where("border is not null").select("border", *[f.split()[0] for f in ORDERED.split(", ")])
    met = borders.repartition("border").sortWithinPartitions("border", *key).mapInArrow(scan_borders, STARS)
    stars = scanned.where("node is not null").select("node", "root", "partner", "estimate").unionByName(met)
    least = written(stars.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots"), F.max(F.struct("estimate", "partner")).alias("best")), "stars")
    ends = F.filter(F.concat(F.array("node"), "roots"), lambda x: x != F.col("low"))
    return least.select(F.explode(ends).alias("a"), F.col("low").alias("b")).distinct(), least.select(F.col("node").alias("a"), F.col("best.partner").alias("b"))


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets are at the threshold or above."""
    both = np.concatenate([one, two])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (len(both) - shared)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, one, two) whose sets are similar."""
    for batch in batches:
        keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(reps: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, own: np.ndarray, open_: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the sets of a cluster, confirmed on full sets: of every open one with all others.

    Sets of equal ``own`` are connected already.
    """
    order = np.lexsort((reps, ~open_))
    reps, sets, sigs, own, n_open = reps[order], [sets[i] for i in order], sigs[order], own[order], int(open_.sum())
    sizes = np.array([len(s) for s in sets], np.int64)
    firsts, seconds, scores = [], [], []
    for i in range(n_open):
        estimate = (sigs[i + 1 :] == sigs[i]).mean(1)
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        hit = np.flatnonzero((estimate >= CONFIRM) & (SIMILARITY[1] * small >= SIMILARITY[0] * large) & (own[i + 1 :] != own[i]))
        firsts.append(np.full(len(hit), i))
        seconds.append(hit + i + 1)
        scores.append(estimate[hit])
    group = np.unique(own, return_inverse=True)[1].tolist()
    parent = list(range(len(reps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    if firsts:
        first, second, score = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(scores)
        for k in np.argsort(-score, kind="stable"):
            i, j = int(first[k]), int(second[k])
            x, y = root(group[i]), root(group[j])
            if x != y and similar(sets[i], sets[j]):
                parent[max(x, y)] = min(x, y)
                links.append((int(reps[i]), int(reps[j])))
    return links


def _confirm_task(pdf: pd.DataFrame) -> pd.DataFrame:
    links: list[tuple[int, int]] = []
    for _, part in pdf.groupby(["cluster"], sort=False):
        sigs = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(len(part), -1)
        links += confirm(part["rep"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) for x in part["shingles"]], sigs, part["own"].to_numpy(np.int64), part["open"].to_numpy(bool))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def open_tasks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(task, cluster, rep, sig, own, open): what is left to compare of clusters that their near pairs don't connect.

    Open are all sets outside a cluster's largest connected part; every open
    set meets every set of its cluster. Small clusters share tasks. In large
    ones, open sets are dealt to blocks, as are all sets, and block meets block;
    the work grows with the open sets times all, not with the square of all.
    """
    placed = members.join(labels.select(F.col("node").alias("rep"), F.col("label").alias("own")), "rep", "left").withColumn("own", F.coalesce("own", "rep"))
    by_part = placed.groupBy("cluster", "own").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    n = F.sum("n")
    clusters = by_part.groupBy("cluster").agg(n.alias("n"), F.max("n").alias("most"), F.max(F.struct("n", "own"))["own"].alias("largest"), F.count("*").alias("parts"), F.sum("shingles").alias("shingles")).where("parts > 1")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(F.col("shingles") * n / F.col("n") / BLOCK_SHINGLES), F.lit(1)).cast("long")
    clusters = clusters.select("cluster", "largest", blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("most")).alias("open_blocks"))
    left = written(placed.join(clusters, "cluster").withColumn("open", F.col("own") != F.col("largest")), "open-clusters")
    tasks = max(1, left.where("blocks = 1").count() // BLOCK_ROWS)
    columns = ["cluster", "rep", "sig", "own", "open"]
    task = lambda c, i, j: F.struct(c.alias("c"), i.alias("i"), j.alias("j")).alias("task")
    none = F.lit(0).cast("long")
    small = left.where("blocks = 1").select(task(F.lit(-1).cast("long"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)), none), *columns)
    large = left.where("blocks > 1")
    upto = lambda n: F.explode(F.sequence(none, F.col(n) - 1))
    asking = large.where("open").withColumn("i", F.pmod(F.xxhash64("rep"), "open_blocks")).withColumn("j", upto("blocks"))
    asked = large.withColumn("open", F.lit(False)).withColumn("j", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("i", upto("open_blocks"))
    met = [x.select(task(F.col("cluster"), F.col("i"), F.col("j")), *columns) for x in (asking, asked)]
    return small.unionByName(met[0]).unionByName(met[1])


def near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row, by shingles of ``n`` words."""
    spark = docs.sparkSession
    small_batches(spark)
    sketched = written(sketches(docs, n), "sketches")
    usable = sketched.where("fp is not null and doc_id is not null")
    # One row for each set.
    classes = written(usable.groupBy("fp").agg(F.first("rep").alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")

    rows = written(forest(classes), "forest")
    several = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    met = rows.join(several, "region", "left_semi").join(classes.select("rep", "sig"), "rep")
    edges, near = candidates(met)
    clusters = components(written(edges, "candidates"), "clusters")

    members = written(clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")).join(classes.select("rep", "least", "sig", "n_shingles"), "rep"), "members")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(utf8(batch.column(1)), n)
            yield pa.RecordBatch.from_arrays([pa.array([print_of(s)[1] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    wanted = members.select(F.col("least").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if members.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    sets = written(texts.mapInArrow(shingle, "rep long, shingles binary").join(members.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")
    of = lambda side, name: sets.select(F.col("rep").alias(side), F.col("shingles").alias(name))
    pairs = near.join(of("a", "one"), "a").join(of("b", "two"), "b").select("a", "b", "one", "two")
    first = written(pairs.mapInArrow(confirmed, "a long, b long"), "first-links")
    dealt = open_tasks(members.drop("least"), components(first, "first-labels"))
    links = written(dealt.join(sets, "rep").groupBy("task").applyInPandas(_confirm_task, "a long, b long").unionByName(first), "links")
    least = classes.select("rep", "least")
    met = links.join(least.select(F.col("rep").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("rep").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = usable.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    same = usable.select("doc_id", "rep").join(several, "doc_id", "left_semi").distinct().join(least, "rep").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    labels = components(met.unionByName(same), "components").select(F.col("node").alias("least"), "label")

    named = classes.select("fp", "least").join(labels, "least", "left").select("fp", F.coalesce("label", "least").alias("label"))
    found = sketched.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
