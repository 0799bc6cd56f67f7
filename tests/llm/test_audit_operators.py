"""Source divergence, toxicity and collocations: against brute force, on hot groups, and edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import collocations, divergence, toxicity
from lexweave.llm.queries import remainder

DOCS = "doc_id long, text string, lang string, source string, term string, score double, rank int, block string"


def docs(spark, rows):
    """Rows (text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, s, "x", 0.5, 1, "b") for i, (t, l, s) in enumerate(rows)], DOCS)


def written_words(n, seed, size=40):
    dealt = random.Random(seed)
    letters = ["a", "b", "ß", "C"]
    words = ["".join(dealt.choice(letters) for _ in range(dealt.randint(1, 3))) for _ in range(size)]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!"]
    return ["".join(dealt.choice(words) + dealt.choice(ends) for _ in range(dealt.randint(0, 60))) for _ in range(n)]


# 11. Source divergence


def brute_divergence(rows, least, top):
    lower = {i: i + 32 for i in range(65, 91)}
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(words)
        having[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in having[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: share(counts[lang, s][w], total[s]) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s][w] for s in sources), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(items, 1)}
    return out


@pytest.mark.parametrize("cells", [1 << 18, 7])
def test_divergence_equals_brute_force_in_any_blocks(spark, cells):
    dealt = random.Random(3)
    rows = [(t, dealt.choice(["en", "de", None, "", "fr"]), dealt.choice(["é", "z", "a", None, ""])) for t in written_words(150, 1)]
    rows += [(None, "en", "alone"), ("Once", "xx", "s1"), ("twice", "xx", "s2"), ("no others", "yy", "s")] + [rows[0]] * 40
    got = divergence.divergences(docs(spark, rows), top=5, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows, 3, 5)


def test_divergence_where_sizes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_LANGUAGES", 0)
    rows = [(t, "en", f"s{i % 4}") for i, t in enumerate(written_words(60, 2))]
    assert {tuple(r) for r in divergence.divergences(docs(spark, rows)).collect()} == brute_divergence(rows, 3, 200)


def test_divergence_passes_counts_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    rows = [(t, "en", f"s{i % 2}") for i, t in enumerate(written_words(30, 5))]
    assert {tuple(r) for r in divergence.divergences(docs(spark, rows)).collect()} == brute_divergence(rows, 3, 200)


def test_shares_beyond_64_bits_of_the_plain_product():
    counts, total = np.array([[0, 10**12, 3 * 10**14]]), np.array([[4 * 10**14 + 7]])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * (c + 1) // (4 * 10**14 + 7) for c in counts[0].tolist()]]


def test_divergence_of_no_rows(spark):
    assert divergence.divergences(docs(spark, []).limit(0)).collect() == []


# 12. Toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automata_find_what_edit_distance_says():
    dealt = random.Random(9)
    make = lambda low, high: "".join(dealt.choice("abé") for _ in range(dealt.randint(low, high)))
    terms, words = list({make(1, 8) for _ in range(60)}), list({make(1, 10) for _ in range(300)}) + ["", "x" * 60, "é" * 32]
    for k in (0, 1, 2):
        got = {(w, t, e) for w, t, e in toxicity.Trie(list(enumerate(terms)), k).hits(words)}
        assert got == {(i, j, distance(w, t)) for i, w in enumerate(words) for j, t in enumerate(terms) if distance(w, t) <= k and len(w) >= min(map(len, terms)) - k}
    got = {(w, t) for w, t, _ in toxicity.Trie(list(enumerate(terms)), 0, True).hits(words)}
    assert got == {(i, j) for i, w in enumerate(words) for j, t in enumerate(terms) if w.startswith(t)}


def test_nearest_term_and_its_edits():
    lexicon = toxicity.Lexicon(["wretch", "scoundrels", "vil*", "cur"], [1.0, 1.0, 1.0, 1.0])
    assert lexicon.lookup(["wretch", "wretsh", "wreck", "scundrelz", "villainous", "cut", "curs", "other"]) == {"wretch": (0, 0), "wretsh": (0, 1), "scundrelz": (1, 2), "villainous": (2, 0)}


def test_places_words_around_and_quotation_marks():
    reader = toxicity.Reader(toxicity.Lexicon(["wretch"], [1.0]))
    ((hits, n),) = reader.hits(['a b c d e f You WRETCH, go now\nhe said "you wretch" and “wretch” then\n" wretch'])
    assert n == 18 and [(e, q) for _, e, q, _ in hits] == [(0, False), (0, True), (0, True), (0, True)]
    assert hits[0][3] == ["c", "d", "e", "f", "you", "go", "now", "he", "said", "you"]


def made_labels(spark, seed=4, n=900):
    """Every third text insults openly, sometimes misspelled; another third quotes the insult in fewer cases."""
    dealt = random.Random(seed)
    plain = ["the", "river", "bank", "holds", "many", "notes", "rate", "paper", "old", "street", "garden", "and", "was", "number"] + [f"word{i}" for i in range(200)]
    bad = ["scoundrel", "wretched", "vilemonger"]
    rows, labels = [], []
    for i in range(n):
        words = [dealt.choice(plain) for _ in range(dealt.randint(10, 60))]
        kind, at = i % 3, dealt.randrange(10)
        words[5:5] = ["you", "are", "a", "article", "quotes", "reported"]
        word = dealt.choice(bad)
        if kind == 0:
            word = word.replace("n", "m", 1) if dealt.random() < 0.15 else word
            words[at:at] = ["you", "are", "a", word]
            words[-3:-3] = [dealt.choice(bad)]
        elif kind == 1 and dealt.random() < 0.5:
            words[at:at] = ["article", "quotes", f'"{word}"', "reported"]
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(kind == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), bad


def test_toxicity_tells_abuse_from_quotation_on_held_out_texts(spark):
    frame, labels, bad = made_labels(spark)
    held_out = lambda doc_id: remainder(doc_id, 5) == 0
    model = toxicity.train(frame, labels, held_out)
    assert set(model.lexicon.lookup(bad)) == set(bad) and not model.lexicon.lookup(["you", "river", "quotes"])
    assert model.quoted < 0 < model.open
    got = toxicity.score(frame, model).join(labels, "doc_id").where(held_out(labels["doc_id"])).collect()
    right = sum((r["score_"] >= 0.5) == bool(r["toxic"]) for r in got)
    assert right >= 0.97 * len(got) > 100
    quoted = [r for r in got if 'quotes "' in r["text"]]
    assert len(quoted) > 10 and all(r["score_"] < 0.5 for r in quoted)
    misspelled = [r for r in got if r["toxic"] and "scoumdrel" in r["text"]]
    assert misspelled and all(r["score_"] >= 0.5 for r in misspelled)


def test_toxicity_edge_cases(spark):
    frame, labels, _ = made_labels(spark, n=300)
    never = lambda doc_id: doc_id < 0
    edges = spark.createDataFrame([(None, None, 0.1), (1, "", 0.1), (1, "", 0.1), (2, "wort " * 200_000, 0.1), (3, "ı̇İ퟿", 0.1)], frame.schema)
    model = toxicity.train(frame.unionByName(edges), labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (0, 0)], labels.schema)), never)
    got = toxicity.score(edges, model)
    assert got.columns == ["doc_id", "text", "score", "score_"]
    scores = [r["score_"] for r in got.collect()]
    assert len(scores) == 5 and all(0 <= s < 0.5 for s in scores)
    assert toxicity.score(edges.limit(0), model).collect() == []
    for none in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        only = toxicity.train(frame, none, never)
        (one,) = {r["score_"] for r in toxicity.score(edges, only).collect()}
        assert one == pytest.approx({0: 0.25, 100: 100.5 / 102, 200: 0.5 / 202}[none.count()], abs=0.005)


def test_copies_of_one_text_leave_the_sample(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(80)) + f" {i}" if i < 50 else f"other {i} text{i} here{i} and{i} more{i}", 1, 1) for i in range(60)] + [(60, "", 1, 1), (61, "", 1, 1)]
    got = toxicity.one_of_copies(spark.createDataFrame(rows, "doc_id long, text string, half int, label int"))
    assert sorted(r.doc_id for r in got.collect())[-12:] == list(range(50, 62)) and got.count() <= 14


# 13. Collocations


def brute_collocations(rows, support, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in candidates.items():
            inside = lambda x: any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1))  # noqa: B023, E731
            if any(len(x) > len(p) and b >= a and inside(x) for x, b in candidates.items()):
                continue
            score, k = min((1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def phrase_rows(seed=6, n=200):
    dealt = random.Random(seed)
    words = ["of", "the", "Bank", "rate", "é", "a", "notes", "x\x1cy"]
    weights = [9, 8, 3, 3, 2, 4, 1, 1]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", "\r", "\x0b", "?"]
    text = lambda: "".join(w + dealt.choice(ends) for w in dealt.choices(words, weights, k=dealt.randint(0, 50)))
    return [(text(), dealt.choice(["en", "en", "en", None, "de"])) for _ in range(n)] + [(None, "en"), ("", None), ("the the the the the the the", "en")]


@pytest.mark.parametrize(("block", "hot"), [(4 << 20, 100_000), (64, 3), (300, 40)])
def test_collocations_equal_brute_force_in_any_blocks_and_parts(spark, block, hot):
    rows = phrase_rows()
    frame = docs(spark, [(t, lang, "s") for t, lang in rows] + [(rows[0][0], rows[0][1], "s")] * 9)
    got = collocations.collocations(frame, support=12, top=25, block_bytes=block, hot=hot)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows + [rows[0]] * 9, 12, 5, 25)


def test_each_occurrence_has_one_pivot():
    places = np.array([3, 1, 3, 3, 2, 0, 1, 1], np.int32)
    rows, has = collocations.windows(places, np.append((places[:-1] > 0) & (places[1:] > 0), False), 4)
    seen = Counter()
    for row in rows[has].tolist():
        for first, last in itertools.product(range(5), range(4, 9)):
            if 2 <= last - first <= 4 and all(row[first : last + 1]):
                seen[tuple(row[first : last + 1])] += 1
    runs = [[3, 1, 3, 3, 2], [1, 1]]
    parted, _ = collocations.windows(places, np.zeros(8, bool), 4)
    assert (parted[:, [3, 5]] == 0).all()
    assert seen == Counter(tuple(r[i : i + m]) for r in runs for m in range(3, 6) for i in range(len(r) - m + 1))


def test_frequent_pairs_of_a_block_go_by_parts_not_by_rows(spark, monkeypatch):
    made, written = {}, collocations.written
    monkeypatch.setattr(collocations, "written", lambda frame, name: made.setdefault(name, written(frame, name)))
    dealt = random.Random(4)
    texts = [" ".join(dealt.choices([f"w{i}" for i in range(60)], k=400)) for _ in range(60)]
    _, phrases, _ = collocations.frequent_phrases(docs(spark, [(t, "en", "s") for t in texts]), support=2, longest=3, block_bytes=40_000)
    pairs = Counter(p for t in texts for p in zip(t.split(), t.split()[1:], strict=False))
    frequent = {" ".join(p): n for p, n in pairs.items() if n >= 2}
    assert {r.phrase: r.n for r in phrases.collect() if r.phrase.count(" ") == 1} == frequent
    assert len(frequent) > 3000 and made["frequent-pairs"].count() <= 32 * (made["phrase-blocks"].count() + 1)


def test_frequent_words_have_numbers_without_gaps(spark):
    asked = spark.createDataFrame([(b, lang, f"w{i}", i, 2) for b in range(3) for lang in ("en", "de") for i in range(50)], "block long, lang string, word string, at int, n long")
    rows = collocations.frequent_words(asked.repartition(5), 6).collect()
    assert sorted(r.id for r in rows) == list(range(100)) and all(r.f == 6 and {(p.block, p.at) for p in r.places} == {(b, int(r.word[1:])) for b in range(3)} for r in rows)


def test_packed_columns_come_back():
    for table in (np.zeros((3, 0), np.int64), np.array([[0, -1, 2**62], [5, 300, 70_000]])):
        assert np.array_equal(collocations.unpacked(collocations.packed(*table), len(table)), table)


def test_scores_whose_products_pass_64_bits(spark):
    words = spark.createDataFrame([("en", "x", 3 * 10**12), ("en", "y", 10**12)], "lang string, phrase string, n long")
    phrases = spark.createDataFrame([("en", "x y", 10**11 + 7)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    assert collocations.scored(words, phrases, totals).collect()[0]["score"] == 1000 * (10**11 + 7) * 9 * 10**15 // (3 * 10**24)


def test_collocations_of_no_rows_and_long_texts(spark):
    assert collocations.collocations(docs(spark, []).limit(0)).collect() == []
    long = [("go on " * 40_000 + "é" * 9000, "en")]
    got = collocations.collocations(docs(spark, [(*long[0], "s")]), block_bytes=1000)
    assert {tuple(r) for r in got.collect()} == brute_collocations(long, 100, 5, 2000)


def test_arrow_tables_of_a_block_without_terms():
    groups = pa.table({"lang": ["en", "en"], "block": [0, 0], "source": ["b", "a"], "total": pa.array([0, 0], pa.int64()), "kept": pa.array([0, 0], pa.int64())})
    terms = pa.table({"lang": pa.array([], pa.string()), "block": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "cells": pa.array([], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))})
    assert divergence.tile(terms, groups, 5).to_pylist() == [{"lang": "en", "source": s, "part": "pair", "item": o, "value": 0} for s, o in (("a", "b"), ("b", "a"))]
