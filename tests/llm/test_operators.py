"""Each operator on small fixtures: against brute force, exact round trips, and edge cases."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import ann, bpe, ctw, langid, licenses, line_dedup, media, minhash_forest, packing, quality
from lexweave.llm.components import components

DOCS = "doc_id long, text string, score double, label int"


def docs(spark, texts):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", " \n\t ", "one", "one two", "é" * 3000, "long " * 30000, "same text here now", "same text here now"]


@pytest.fixture(scope="module")
def edge_docs(spark):
    frame = docs(spark, EDGES)
    return frame.unionByName(frame.where("doc_id = 7")).unionByName(spark.createDataFrame([(None, "no id at all", 0.1, 0)], DOCS))


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# 1. Near duplicates


def shingles(text, n):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts, n):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def copies(seed, groups=12, words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(1 + 3 * (g % 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    texts = copies(n) + EDGES
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(docs(spark, texts).select("doc_id", "text"), n).collect()}
    assert got == brute_components(texts, n)


def test_near_duplicates_edges(spark, edge_docs, no_docs):
    rows = minhash_forest.near_duplicates(edge_docs).collect()
    assert len(rows) == len(EDGES) + 2
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[0] == {(0, 0)} and by[2] == {(0, 2)} and by[7] == by[8] | by[7] and {c for _, c in by[8]} == {7} and by[None] == {(1, None)}
    assert minhash_forest.near_duplicates(no_docs).collect() == []


def test_every_candidate_of_a_region_is_kept():
    last, far = np.arange(100, dtype=np.uint32), np.arange(100, dtype=np.uint32)
    far[65:] += 1000
    near = [np.where(np.arange(100) < 30 + k, last + 5000, last).astype(np.uint32) for k in range(4)]
    # The first is a candidate of the last alone, the four between are nearer to it.
    sigs = [far, *near, last]
    assert all((far == x).mean() < minhash_forest.CANDIDATE < (last == x).mean() for x in near) and (far == last).mean() >= minhash_forest.CANDIDATE
    columns = [pa.array([7] * 6, pa.int64()), pa.array([bytes([i]) for i in range(6)], pa.binary()), pa.array(range(10, 16), pa.int64()), pa.array([x.tobytes() for x in sigs], pa.binary())]
    rows = [r for b in minhash_forest.scan(iter([pa.RecordBatch.from_arrays(columns, ["region", "rest", "rep", "sig"])])) for r in b.to_pylist()]
    assert {(r["node"], r["root"]) for r in rows if r["node"]} == {(x, 10) for x in range(11, 16)}
    assert next(r["partner"] for r in rows if r["node"] == 15) == 11 and len([r for r in rows if r["border"] is not None]) == 12


def test_regions_go_on_across_the_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "REACH", 4)
    width = minhash_forest.TREES * minhash_forest.DEPTH
    sigs = [((i + np.arange(width)) // width).astype(np.uint32) << np.uint32(16) for i in range(400)]
    rows = spark.createDataFrame([(7, 0, 1000 - i if i % 2 else i, s.tobytes()) for i, s in enumerate(sigs)], "region long, tree int, rep long, sig binary")
    edges, near = minhash_forest.candidates(rows)
    assert dict(components(edges).collect()) == {1000 - i if i % 2 else i: 0 for i in range(400)}
    assert all(a > b for a, b in near.collect())


def test_crowded_region_and_open_sets(spark, monkeypatch):
    """Hundreds of texts share most of a passage, some by enough to be linked; recall is 1 against all pairs."""
    monkeypatch.setattr(minhash_forest, "REACH", 16)
    monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", 64)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    edited = lambda text, n: [word() if i in places else w for places in [set(rng.sample(range(280), n))] for i, w in enumerate(text)]
    texts = [edited(base, 7) for _ in range(300)]
    texts += [edited(texts[k], 7) for k in range(0, 300, 5)]
    other = [word() for _ in range(300)]
    texts += [[*other[:-i], *(word() for _ in range(i))] for i in range(1, 40)]
    texts = [" ".join(t) for t in texts]
    want = brute_components(texts, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(docs(spark, texts), 4).collect()}
    assert len({c for _, c in want.values()}) > 100 and got == want


def test_two_texts_of_one_id_are_one_document(spark):
    one, two, other = ("red green blue", "sun moon star sky", "oak elm ash fir")
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(5, one), (5, two), (6, one), (7, two), (3, near), (8, near + " end"), (8, other), (9, other), (4, "alone here now"), (4, None), (6, None)]
    found = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.n_shingles} == {5: 5, 6: 5, 7: 5, 3: 3, 8: 3, 9: 3, 4: 4}


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", 4)
    texts = copies(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(docs(spark, texts), 4).collect()}
    assert got == brute_components(texts, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40, 60)] + [(5, 1), (1, 9), (100, 100), (70, 71)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 40 for i in range(40, 61)} | {5: 1, 1: 1, 9: 1, 70: 70, 71: 70}


# 2. Media


def scene(seed, size=96):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (size // 6, size // 6)), np.ones((6, 6))).astype(np.uint8)


def pgm(image):
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def png(image):
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = image.shape[1].to_bytes(4, "big") + image.shape[0].to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    rows = b"".join(b"\x02" + (row - before).astype(np.uint8).tobytes() for row, before in zip(image, np.vstack([np.zeros((1, image.shape[1]), np.uint8), image[:-1]]), strict=True))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_copies(spark):
    a, b = scene(1), scene(2)
    edited = np.clip(a.astype(int) + 9, 0, 255).astype(np.uint8)
    edited[10:24, 10:24] = 128
    images = [pgm(a), pgm(b), pgm(a[12:90, 18:96]), png(edited), pgm(np.rot90(b).copy()), None, b"", b"P5 broken", pgm(np.zeros((40, 40), np.uint8)), pgm(a)]
    frame = spark.createDataFrame(list(enumerate(images)), "id long, data binary")
    got = {r.id: r for r in media.image_groups(frame).collect()}
    assert len(got) == len(images)
    assert [got[i].group_id for i in (0, 2, 3, 9)] == [0] * 4 and got[1].group_id == 1
    assert all(got[i].group_id == i and got[i].n_corners == 0 for i in (5, 6, 7, 8))
    assert media.image_groups(spark.createDataFrame([], "id long, data binary")).collect() == []


def brute_links(images):
    """Pairs of images by every corner against every corner: an equal part of the descriptor, and few bits apart; without joins."""
    found = [media.corners(media.decode_image(x)) for x in images]
    pack = lambda p: (int(p[0]) << 38) | (int(p[1]) << 8) | (int(p[2]) << 5) | int(p[3])
    links = set()
    for i, j in itertools.combinations(range(len(images)), 2):
        (p1, d1), (p2, d2) = found[i], found[j]
        if not len(p1) or not len(p2):
            continue
        apart = d1[:, None, :] ^ d2[None, :, :]
        shared = (apart.reshape(len(d1), len(d2), media.TABLES, -1) == 0).all(3).any(2)
        near = np.bitwise_count(apart).sum(2) <= media.HAMMING
        votes = {(pack(p1[a]), pack(p2[b])) for a, b in zip(*np.nonzero(shared & near), strict=True)}
        rows = np.array(sorted(votes), np.int64).reshape(-1, 2)
        if len(votes) >= media.VOTES and media.consensus(rows[:, 0], rows[:, 1]) >= media.INLIERS:
            links.add((i, j))
    return links


def test_repeated_texture_keeps_all_its_corners(spark):
    tile = scene(5, 24)
    tiled, other = np.tile(tile, (4, 4)), scene(6)
    other[12:60, 12:60] = np.tile(tile, (2, 2))
    images = [pgm(tiled), pgm(other), pgm(np.tile(tile, (3, 4))[6:, 5:]), pgm(scene(7))]
    corners, descriptors = media.corners(media.decode_image(images[0]))
    keys, at = media.keyed(descriptors.tobytes())
    assert len(keys) == media.TABLES * len(corners) and set(at) == set(range(len(corners)))
    assert len(np.unique(keys)) < len(keys) / 2
    links = brute_links(images)
    got = {r.id: r for r in media.image_groups(spark.createDataFrame(list(enumerate(images)), "id long, data binary")).collect()}
    assert {(0, 1), (0, 2), (1, 2)} <= links
    assert {i: got[i].n_links for i in got} == {i: sum(i in x for x in links) for i in range(len(images))}


def test_consensus_equals_trying_every_cell():
    dealt = np.random.default_rng(2)
    for _ in range(20):
        n = int(dealt.integers(1, 60))
        pack = lambda x, y, t: (x << 38) | (y << 8) | t
        x, y = dealt.integers(0, 40, n), dealt.integers(0, 40, n)
        first = pack(x, y, dealt.integers(0, 2, n))
        second = pack(x + dealt.integers(0, 12, n), y + dealt.integers(0, 12, n), dealt.integers(0, 2, n))
        best = 0
        x1, y1, t1, x2, y2, t2 = first >> 38, (first >> 8) & 0x3FFFFFFF, first & 31, second >> 38, (second >> 8) & 0x3FFFFFFF, second & 31
        turn = (t2 - t1) % media.ANGLES
        for t in np.unique(turn):
            near = np.minimum((turn - t) % media.ANGLES, (t - turn) % media.ANGLES) <= 1
            a = 2 * np.pi * t / media.ANGLES
            sx, sy = x2 - (np.cos(a) * x1 - np.sin(a) * y1), y2 - (np.sin(a) * x1 + np.cos(a) * y1)
            for cx, cy in zip(np.rint(sx[near] / 3) * 3, np.rint(sy[near] / 3) * 3, strict=True):
                inside = near & (np.abs(sx - cx) <= 3) & (np.abs(sy - cy) <= 3)
                best = max(best, min(len(set(first[inside])), len(set(second[inside]))))
        assert media.consensus(first, second) == best


@pytest.mark.parametrize("block", [1000, 3])
def test_image_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(media, "BLOCK", block)
    base, images = scene(3), []
    for k in range(8):  # edited copies, so that each shares its keys with others between
        edited = base.copy()
        edited[6 * k : 6 * k + 42, 6 * k : 6 * k + 42] = scene(50 + k, 42)
        images.append(edited)
    images += [images[2], images[2], images[2], scene(4), scene(4)[12:]]
    images = [pgm(x) for x in images]
    links = brute_links(images)
    assert len(links) > 20
    got = {r.id: r for r in media.image_groups(spark.createDataFrame(list(enumerate(images)), "id long, data binary")).collect()}
    assert {i: got[i].n_links for i in got} == {i: sum(i in x for x in links) for i in range(len(images))}
    linked = {x: y for x, y in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert {i: got[i].group_id for i in got} == {i: linked.get(i, i) for i in range(len(images))}


def test_small_crops_are_linked(spark):
    images = [pgm(scene(3)), pgm(scene(3)[24:66, 24:66]), pgm(scene(4))]
    got = {r.id: (r.n_links, r.group_id) for r in media.image_groups(spark.createDataFrame(list(enumerate(images)), "id long, data binary")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_pages_become_images():
    assert media.rasterise(None) is None and media.rasterise("<script>x</script>") is None
    assert media.decode_image(media.rasterise("<p>one two<p>three<br>four five")).shape == (12, 128)


# 3. Line dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(texts, least=10):
    seen, out = [], {}
    for i, text in enumerate(texts):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            key = line.strip(" \t\r")
            if len(key) < least:
                kept.append(line)
                continue
            if not any(within_one(key, x) for x in seen):
                kept.append(line)
            seen.append(key)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.choice([8, 12, 40, 150, 300]))) for _ in range(25)]
    texts = []
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(0, 8)):
            line = list(rng.choice(base))
            at = rng.randrange(len(line))
            change = rng.randrange(6)
            if change == 0:
                line[at] = "z"
            elif change == 1:
                del line[at]
            elif change == 2:
                line.insert(at, "y")
            lines.append(" " * rng.randrange(2) + "".join(line))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "\n".join(["x" * 5000, "x" * 4999, "y" * 5000])]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got == brute_lines(texts)


def test_line_dedup_edges(spark, edge_docs, no_docs):
    found = line_dedup.dedup_lines(edge_docs, count="gone")
    assert found.columns == ["doc_id", "text", "score", "label", "gone"]
    rows = found.collect()
    assert len(rows) == len(EDGES) + 2
    assert {r.text for r in rows if r.doc_id == 7} == {"same text here now"} and {r.text for r in rows if r.doc_id == 8} == {""}
    assert {r.text for r in rows if r.doc_id is None} == {"no id at all"}
    assert line_dedup.dedup_lines(no_docs).collect() == []


# 4. Quality, 5. Language


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 1] > 0.2) ^ (x[:, 4] > -0.1)).astype(float)
    model = quality.boost(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    walked = []
    for row in x[2000:2050]:  # one row at a time, by the arrays
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        walked.append(1 / (1 + math.exp(-total)))
    assert np.allclose(walked, model.score(x[2000:2050]))
    assert quality.boost(x[:5], np.ones(5)).score(x[:2])[0] > 0.5


def slow_boost(x, y):
    """Margins of the training rows: every split of every node tried one by one."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    margin = np.full(n, math.log(prior / (1 - prior)))
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]).astype(np.float32))) for j in range(width)]
    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        step = np.zeros(n)

        def gain(rows, g=g, h=h):
            return g[rows].sum() ** 2 / (h[rows].sum() + quality.LEAF_PENALTY)

        def grow(rows, depth):
            if depth == quality.DEPTH:
                step[rows] = quality.LEARNING_RATE * g[rows].sum() / (h[rows].sum() + quality.LEAF_PENALTY)  # noqa: B023
                return
            best, split = 1e-12, None
            for j in range(width):
                for cut in cuts[j]:
                    low, high = [r for r in rows if x[r, j] <= cut], [r for r in rows if x[r, j] > cut]
                    if min(len(low), len(high)) >= quality.LEAF_ROWS and (found := gain(low) + gain(high) - gain(rows)) > best + 1e-9:
                        best, split = found, (low, high)
            for part in split or (rows,):
                grow(part, depth + 1)

        grow(list(range(n)), 0)
        margin += step
    return margin


def test_trees_equal_a_search_of_all_splits(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.3) | (x[:, 2] < -0.8)).astype(float)
    want = 1 / (1 + np.exp(-slow_boost(x, y)))
    assert np.allclose(quality.boost(x, y).score(x), want, atol=1e-9)


def test_quality_held_out(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    held = lambda i: F.crc32(i.cast("string")) % 4 == 2
    found = quality.score(frame, quality.train(frame, labels, held)).where(held(F.col("doc_id"))).join(labels, "doc_id")
    assert found.columns[: len(frame.columns)] == frame.columns
    assert found.agg(F.avg(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.9


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(7, 1), (3, 0), (None, 1), (4, None), (7, 1)], "doc_id long, quality int")
    never = lambda i: F.lit(False)
    model = quality.train(edge_docs, labels, never)
    rows = quality.score(edge_docs.drop("score"), model).collect()
    assert len(rows) == len(EDGES) + 2 and all(0 <= r.score <= 1 for r in rows)
    clashing = quality.score(edge_docs, model)
    assert clashing.columns == [*edge_docs.columns, "score_"] and {r.score for r in clashing.collect()} <= {0.5, 0.1}
    empty = quality.train(no_docs, labels, never)
    assert {r.score for r in quality.score(edge_docs.drop("score"), empty).collect()} == {0.5}
    assert quality.score(no_docs.drop("score"), model).collect() == []


def test_language_held_out(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.identify(frame, langid.train(frame.where(~held))).where(held)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_kernel_is_the_blend_of_presence_kernels():
    texts = [b"abracadabra", b"abra cad", b"zzz", b""]
    x = langid.presence(texts)
    got = langid.kernel(x, x.astype(np.float32))
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    for i, j in itertools.product(range(3), range(3)):
        want = np.mean([len(grams(texts[i], n) & grams(texts[j], n)) / max(1, math.sqrt(len(grams(texts[i], n)) * len(grams(texts[j], n)))) for n, _ in langid.ORDERS])
        assert abs(got[i, j] - want) < 1e-5


def test_fit_is_kernel_ridge_regression_on_landmarks():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(words) for _ in range(12)).encode() for words in (["der", "hund", "und"], ["the", "cat", "and"]) for _ in range(30)]
    labels = ["de"] * 30 + ["en"] * 30
    features = langid.presence(texts)
    model = langid.fit(features, labels)
    marks = model.landmarks.astype(np.float32)
    k, kmm = langid.kernel(features, marks).astype(float), langid.kernel(model.landmarks, marks).astype(float)
    targets = np.array([[1.0 if x == m else -1.0 for m in model.languages] for x in labels])
    # The solution in the span of the landmarks, without a whitened map; a pseudo-inverse takes equal landmarks.
    slow = k @ np.linalg.pinv(k.T @ k + langid.RIDGE * len(labels) * kmm, rcond=1e-9) @ k.T @ targets
    assert np.allclose(k @ model.weights, slow, atol=1e-3)
    assert [model.languages[i] for i in (k @ model.weights).argmax(1)] == labels


def test_language_edges(spark, edge_docs, no_docs):
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(labelled)
    rows = langid.identify(edge_docs.drop("score"), model).collect()
    assert len(rows) == len(EDGES) + 2
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.train(labelled.where("false")) is None
    assert {r.lang_pred for r in langid.identify(edge_docs.drop("score"), None).collect()} == {"und"}
    assert langid.identify(no_docs.drop("score"), model).collect() == []


# 6. Neighbours


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:400] = x[100]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graphs, shards = ann.index(frame, 11, shard_rows=300)
    assert shards == 3
    asked = ann.usable(frame, "vec_id", "embedding").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ann.nearest(graphs, shards, asked, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-scores[i], i))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(best)) if len({scores[i] for i in best}) > 1 else sum(abs(scores[i] - scores[b]) < 1e-9 for (_, i, _), b in zip(found, best, strict=True))
    assert hits / (10 * len(got)) >= 0.9


def test_query_recall_on_the_table(spark, sf_dir):
    from lexweave.llm import queries

    folder = f"{sf_dir}/../sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"]).astype(float)
    at = {v: i for i, v in enumerate(table["vec_id"])}
    got = {}
    for r in queries.op6_graph_ann(spark, folder).collect():
        assert abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-9
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {v for v in at if v % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = x @ x[at[q]]
        hits += len(found & set(sorted((v for v in at if v != q), key=lambda v: (-scores[at[v]], v))[:20]))
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    graphs, shards = ann.index(frame, 21)
    asked = ann.usable(frame, "vec_id", "embedding").where("vec_id = 20").withColumnRenamed("vec_id", "query_id")
    assert [(r.vec_id, r.score) for r in ann.nearest(graphs, shards, asked, 20).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    none = frame.where("false")
    graphs, shards = ann.index(none, 21)
    assert ann.nearest(graphs, shards, ann.usable(none, "vec_id", "embedding").withColumnRenamed("vec_id", "query_id"), 20).collect() == []


def test_repeated_queries_and_ids(spark):
    dealt = np.random.default_rng(8)
    rows = [(i, [float(x) for x in dealt.normal(size=6)]) for i in range(60)]
    rows += [rows[20], rows[20], rows[33], (40, [float(x) for x in dealt.normal(size=6)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graphs, shards = ann.index(frame, 21, shard_rows=30)
    asked = ann.usable(frame, "vec_id", "embedding").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ann.nearest(graphs, shards, asked, 20, beam=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 20, 40):
        best = {}
        for i, v in rows:
            for j, w in rows:
                if i == q and j != q:
                    best[j] = max(best.get(j, -np.inf), float(np.dot(v, w)))
        want = sorted(best, key=lambda j: (-best[j], j))[:20]
        assert [(r, i) for r, i, _ in got[q]] == list(enumerate(want, 1))
        assert all(abs(s - best[i]) < 1e-9 for _, i, s in got[q])


# 7. Licences


def test_licenses(spark, no_docs):
    mit = licenses.KNOWN["MIT-untitled"]
    texts = ["Copyright (c) 2020 A. Author\n" + mit, mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-licence"), mit + " more", None, "", "!!!", "Copyright 1999 X\nAll rights reserved."]
    got = {r.doc_id: r for r in licenses.find_licenses(docs(spark, texts), licenses.known_digests(spark)).collect()}
    assert [got[i].license_id for i in range(8)] == ["MIT-untitled"] * 3 + [None] * 5
    assert [got[i].digest is None for i in range(3, 8)] == [False, True, True, True, True]
    assert licenses.find_licenses(no_docs, licenses.known_digests(spark)).collect() == []


def test_whole_licences_by_digest(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "MPL-2.0": "MPL-2.0"}
    paths = {k: Path("/usr/share/common-licenses", v) for k, v in files.items()}
    if not all(p.exists() for p in paths.values()):
        pytest.skip("no licence texts on this machine")
    got = licenses.find_licenses(docs(spark, [p.read_text() for p in paths.values()]), licenses.known_digests(spark)).collect()
    assert [r.license_id for r in sorted(got, key=lambda r: r.doc_id)] == list(paths)


# 8. Context-tree weighting


def slow_ctw(pairs):
    """log10 of each pair's mixed probability, node by node."""
    counts = {}
    for (context, byte), n in pairs.items():
        for d in range(ctw.DEPTH + 1):
            for k in range(8):
                node = (context[len(context) - d :] if d else b"", (1 << k) | (byte >> (8 - k)))
                c = counts.setdefault(d, {}).setdefault(node, [0, 0])
                c[(byte >> (7 - k)) & 1] += n
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(c[0] + c[1] + 1) - math.log(math.pi)
    weighted = {ctw.DEPTH: {n: kt(c) for n, c in counts[ctw.DEPTH].items()}}
    for d in range(ctw.DEPTH - 1, -1, -1):
        below = {}
        for (context, p), w in weighted[d + 1].items():
            key = (context[1:], p)
            below[key] = below.get(key, 0) + w
        weighted[d] = {n: np.logaddexp(kt(c), below[n]) - math.log(2) for n, c in counts[d].items()}
    out = {}
    for context, byte in pairs:
        total = 0
        for k in range(8):
            p, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            mixed = None
            for d in range(ctw.DEPTH, -1, -1):
                node = (context[len(context) - d :] if d else b"", p)
                c = counts[d][node]
                estimate = (c[bit] + 0.5) / (sum(c) + 1)
                share = math.exp(kt(c) - math.log(2) - weighted[d][node])
                mixed = estimate if mixed is None else share * estimate + (1 - share) * mixed
            total += math.log10(mixed)
        out[context, byte] = total
    return out


def spelt_pairs(text):
    """(context, byte) of every coded byte of a text, one by one."""
    whole = bytes([ctw.FIRST_MARK]) + b"".join(w + bytes([ctw.CLOSE]) for w in [*(text or "").encode().lower().split(), b""])
    return [(whole[max(0, k - ctw.DEPTH) : k].rjust(ctw.DEPTH, b"\0"), whole[k]) for k in range(1, len(whole))]


def test_context_tree_equals_brute_force():
    rng = random.Random(5)
    pairs = {}
    for text in ["the then thesis a zebra", "verylongword the the", "é ü", "", *[" ".join(rng.choice(["the", "then", "a", "cat", "sat"]) for _ in range(400))]]:
        for key in spelt_pairs(text):
            pairs[key] = pairs.get(key, 0) + (text != "é ü")
    # A node far beyond the table of small counts.
    pairs[next(iter(pairs))] += 1_000_000
    flat = {int.from_bytes(c[::-1], "big") << 8 | b: n for (c, b), n in pairs.items()}
    keys = np.array(sorted(flat), np.int64)
    counts = np.array([flat[k] for k in keys.tolist()], np.int64)
    # Several parts give their sums to the upper depths.
    parts = ctw.part_of(keys, 3)
    sums = [pa.table(ctw.upward(keys[parts == p], counts[parts == p])) for p in np.unique(parts)]
    upper = ctw.upper_levels(pa.concat_tables(sums).group_by("node").aggregate([(c, "sum") for c in ("zeros", "ones", "below")]).rename_columns(["node", "zeros", "ones", "below"]))
    want = {int.from_bytes(c[::-1], "big") << 8 | b: v for (c, b), v in slow_ctw(pairs).items()}
    for p in np.unique(parts):
        got = ctw.code_lengths(keys[parts == p], counts[parts == p], upper)
        assert np.allclose(got, [want[k] for k in keys[parts == p].tolist()], rtol=1e-8, atol=1e-9)


def test_keys_of_pieces_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 50)
    text = ctw.spelled(b" ".join([b"word", b"x" * 500, "\u00e9".encode()] * 9))
    want = [int.from_bytes(c[::-1], "big") << 8 | b for c, b in spelt_pairs(text[1:-1].decode())]
    found = list(ctw.pieces(text))
    assert len(found) > 3 and b"".join(p[lead:] for lead, p in found) == text[1:]
    assert np.concatenate([ctw.keys_of(chunk) for chunk in ctw.chunked(found)]).tolist() == want
    assert ctw.unpacked_keys(ctw.packed_keys(np.sort(want))).tolist() == sorted(want)


@pytest.mark.parametrize("sizes", [(16 << 20, 2 << 20), (300, 40)])
def test_scores_equal_one_tree_over_all_texts(spark, monkeypatch, sizes):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(ctw, "CHUNK_BYTES", sizes[1])
    texts = ["the cat sat on the mat", "le chat est sur le toit", "der hund und die katze", "the dog saw the cat", "cat the sat", "", None, "ein " * 60 + "end" * 50]
    pairs, spelt = {}, {}
    for i, text in enumerate(texts):
        spelt[i] = spelt_pairs(text)
        for key in spelt[i]:
            pairs[key] = pairs.get(key, 0) + (i != 4)
    want = slow_ctw(pairs)
    got = {r.doc_id: r.score for r in ctw.score_documents(docs(spark, texts), F.col("doc_id") == 4).collect()}
    assert all(abs(got[i] - sum(want[k] for k in spelt[i])) < 1e-5 for i in range(len(texts)))


@pytest.mark.parametrize("sizes", [(16 << 20, 2 << 20), (2000, 100)])
def test_base_scores_and_edges(spark, monkeypatch, sizes):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(ctw, "CHUNK_BYTES", sizes[1])
    texts = EDGES + ["The cat and the DOG", "the cat sat", "new words only", "the the the end"]
    rows = [*enumerate(texts), (7, texts[7]), (7, "another text of one id"), (None, "no id at all")]
    frame = spark.createDataFrame([(i, t, 0.5, "x", True) for i, t in rows], "doc_id long, text string, score double, block string, held boolean")
    held = F.col("doc_id") % 3 == 1
    is_held = lambda i: i is not None and i % 3 == 1
    split = lambda t: [*(t or "").encode().lower().split(), None]
    train = [w for i, t in rows if not is_held(i) for w in split(t)]
    counts = {w: train.count(w) for w in set(train)}
    want = []
    for i, t in rows:
        tokens = split(t)
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (len(train) + 0.5 * (len(counts) + 1))) for w in tokens)
        want.append((i is None, i or 0, is_held(i), len(tokens), sum(w in counts for w in tokens), len(train), round(base, 6)))
    found = ctw.score_documents(frame, held).collect()
    assert all(r.score < 0 for r in found)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted(want)
    test_base_scores_and_edges.seen = getattr(test_base_scores_and_edges, "seen", {}) | {sizes: sorted((r.doc_id or -1, round(r.score, 6)) for r in found)}
    assert len({str(x) for x in test_base_scores_and_edges.seen.values()}) == 1


def test_without_training_texts_the_model_is_uniform(spark):
    (row,) = ctw.score_documents(docs(spark, ["ab"]), F.lit(True)).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and abs(row.score - 4 * 8 * math.log10(0.5)) < 1e-5


def test_no_documents_no_scores(spark, no_docs):
    assert ctw.score_documents(no_docs, F.lit(False)).collect() == []


def test_every_known_licence_is_found_in_other_dress(spark):
    dressed = [(name, "Copyright (c) 2020 Some One. All rights reserved.\n\n" + body.upper().replace(" ", "  ").replace(",", " ,")) for name, body in sorted(licenses.KNOWN.items())]
    frame = spark.createDataFrame([(n, t) for n, t in dressed], "name string, text string")
    found = {r.name: r.license_id for r in licenses.find_licenses(frame, licenses.known_digests(spark)).collect()}
    assert found == {n: n for n, _ in dressed}


# All operators


def test_names_in_use_stay(spark):
    rows = [(1, "Permission is hereby granted", 1, 2, 3, "x"), (None, None, 1, 2, 3, "x"), (1, "Permission is hereby granted", 1, 2, 3, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest int, license_id int, n_tokens int, lang_pred string")
    found = licenses.find_licenses(frame, licenses.known_digests(spark))
    assert found.columns == [*frame.columns, "digest_", "license_id_"] and {r.digest for r in found.collect()} == {1} and found.count() == 3
    found = bpe.token_digests(frame, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert "n_tokens_" in found.columns and {r.n_tokens for r in found.collect()} == {3} and len({r.n_tokens_ for r in found.collect()}) == 2
    model = langid.train(spark.createDataFrame([(1, "the cat sat here", "en"), (2, "der hund und die", "de")], "doc_id long, text string, lang string"))
    found = langid.identify(frame, model)
    assert {r.lang_pred for r in found.collect()} == {"x"} and "lang_pred_" in found.columns
    found = line_dedup.dedup_lines(frame, count="digest")
    assert found.columns == [*frame.columns, "digest_"] and sorted((r.doc_id or 0) for r in found.collect()) == [0, 1, 1]


def test_nulls_ties_and_repeated_rows_in_packing(spark):
    path = P.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5), (None, "a b c", 5), (None, None, 5)], "doc_id long, text string, piece int")
    rows = packing.pack(frame, path).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 4), (1, 4), (1, 4)]
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0


def test_packing_ids_are_those_of_the_library(spark):
    import tokenizers

    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(str(path))
    library.encode_special_tokens = True  # strings of special tokens are ordinary text
    encode = packing.tokenizer(path)
    rng = random.Random(4)
    for text in [t for t in EDGES if t and len(t) < 5000] + ["<|endoftext|> naïve Straße 12,345\r\n\t", *("".join(rng.choice("ab é1 .\n'") for _ in range(200)) for _ in range(20))]:
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_images_of_one_id_and_odd_rows(spark):
    one, two = scene(1), scene(2)
    pgm = lambda x: b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.tobytes()
    rows = [(1, pgm(one)), (1, pgm(two)), (1, pgm(one)), (2, pgm(one)), (3, pgm(two)), (None, pgm(one)), (4, None), (5, b""), (6, pgm(one[:4, :4]))]
    frame = spark.createDataFrame([(i, bytearray(d) if d is not None else None, 9) for i, d in rows], "id long, data binary, n_links long")
    found = {r.id: (r.n_links, r.group_id) for r in media.image_groups(frame).collect()}
    assert found == {1: (2, 1), 2: (1, 1), 3: (1, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), None: (0, None)}


def test_descriptors_are_compared_by_their_bits():
    place = np.array([7 << 38 | 9 << 8, 8 << 38 | 9 << 8], np.int64).tobytes()
    base = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], "<u4")
    near, far = base.copy(), base.copy()
    near[:, 1:] ^= np.uint32(0xFF)
    far[:, 1:] ^= np.uint32(0xFFFF)
    met = lambda other: len(media.meetings([(place, base.tobytes())], [(place, other.tobytes())]))
    assert (met(base), met(near), met(far)) == (2, 2, 0)


# 9. Packing


def test_packing_round_trip(spark, no_docs):
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = EDGES + [" ".join(rng.choice(["alpha", "beta", "gamma", "d", "<|endoftext|>"]) for _ in range(rng.randrange(0, 900))) for _ in range(60)]
    rows = packing.pack(docs(spark, texts), path).collect()
    encode = packing.tokenizer(path)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*encode(text or ""), 2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 1024 for p in parts[1:])
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= math.ceil(sum(r.length for r in rows) / 1024) * 1.1 + 1
    assert packing.pack(no_docs, path).collect() == []


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        bins = []
        for length in sorted((x for x, c in histogram.items() for _ in range(c)), reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= length]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= length
            else:
                bins.append(100 - length)
        used = set()
        for length, _, n, each, first, base in packing.plan(histogram, 100):
            assert base + min(each, n) * length <= 100
            used |= {first + r // each for r in range(n)}
        assert len(used) == len(bins)


def test_other_tokenizer_files_use_their_library():
    encode = packing.tokenizer(P.path("word_bpe_49k.json"))
    assert encode("Hello there") and encode("") == []


# 10. BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.TextCodec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


def test_tree_equals_library(codec):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "a" * 5000, "ab" * 900 + "ba" * 77, "don't <|endoftext|> ½²x\r\n\n  y", "é" * 999, " " * 500 + "x"]
    texts += ["".join(rng.choice("etaoin shrdlu") for _ in range(400)) for _ in range(40)]
    texts += ["".join(rng.choice("etaoin") for _ in range(300)) for _ in range(40)]
    texts += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(300)) for _ in range(10)]
    for text in texts:
        packed = codec.encode(text)
        assert list(memoryview(packed).cast("I") if packed else []) == library.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_digests_and_edges(spark, codec, edge_docs, no_docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.token_digests(edge_docs, path, P.PATTERN).collect()
    assert len(rows) == len(EDGES) + 2
    for r in rows:
        packed = codec.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    both = bpe.decode_column(bpe.encode_column(edge_docs, path, P.PATTERN), path).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both)
    assert bpe.token_digests(no_docs, path, P.PATTERN).collect() == []
    assert isinstance(bpe.token_digests(no_docs, path, P.PATTERN).schema["n_tokens"].dataType, T.LongType)


def test_keys_of_images_are_dealt_once(spark, monkeypatch):
    rows = [(1, 10, 2), (1, 11, 1), (1, 12, 3), (2, 10, 1), (2, 12, 1), (3, 11, 4)]
    for block in (1000, 1, 2):
        monkeypatch.setattr(media, "BLOCK", block)
        got = media.shared_keys(spark.createDataFrame(rows, "key long, image long, corners int"))
        assert {tuple(r) for r in got.collect()} == {(10, 11, 2, 1), (10, 12, 3, 4), (11, 12, 1, 3)}
    found = spark.createDataFrame([(i, bytes(range(i, i + 32))) for i in range(4)], "image long, keys binary")
    plan = media.shared_keys(media.key_table(found))._jdf.queryExecution().executedPlan().toString()
    # By a key alone or with its image; the union's two sides share one exchange.
    assert set(re.findall(r"hashpartitioning\(key(?:, image)?, \d+\), \w+", re.sub(r"#\d+L?", "", plan))) == {f"hashpartitioning(key, {spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_COL"}


def block_of(images, first=0):
    found = [media.corners(media.decode_image(x)) for x in images]
    pack = lambda p: (p[:, 0].astype(np.int64) << 38) | (p[:, 1].astype(np.int64) << 8) | (p[:, 2] << 5) | p[:, 3]
    sizes = np.array([len(p) for p, _ in found])
    keys = np.concatenate([d for _, d in found]).view("<u4").reshape(-1, media.TABLES)
    return media.Block(np.arange(first, first + len(images)), np.zeros(len(images), bool), sizes, np.concatenate([pack(p) for p, _ in found]), keys)


@pytest.mark.parametrize("held", [2_000_000, 300, 20])
def test_blocks_agree_as_brute_force(monkeypatch, held):
    monkeypatch.setattr(media, "HELD_PAIRS", held)
    monkeypatch.setattr(media, "HELD_VOTES", held)
    tile, base = scene(5, 24), scene(3)
    other = scene(6)
    other[12:60, 12:60] = np.tile(tile, (2, 2))
    images = [base, base[24:66, 24:66], np.tile(tile, (4, 4)), other, np.tile(tile, (3, 4))[6:, 5:], scene(4), np.rot90(base).copy(), scene(4)[12:], np.rot90(other, 2).copy()]
    images = [pgm(x) for x in images]
    links = brute_links(images)
    assert len(links) > 5
    one, two = block_of(images[:5]), block_of(images[5:], 5)
    found = media.agreeing(one, one) + media.agreeing(one, two) + media.agreeing(two, two)
    assert len(found) == len(set(found)) and set(found) == links


def test_pairs_of_images_are_not_shuffled(spark, monkeypatch):
    def refused(keys):
        raise AssertionError("a row for each pair of images with a key")

    monkeypatch.setattr(media, "shared_keys", refused)
    images = [pgm(scene(3)), pgm(scene(3)[12:]), pgm(scene(4))]
    got = {r.id: r.n_links for r in media.image_groups(spark.createDataFrame(list(enumerate(images)), "id long, data binary")).collect()}
    assert got == {0: 1, 1: 1, 2: 0}
