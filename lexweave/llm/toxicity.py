"""Toxicity by a learned lexicon whose misspelled terms automata catch, weighed by the words around them.

1. Words and beginnings of words become the lexicon if labelled toxic texts have them so
   much more often than others that chance would bring less than one such term;
   their log-odds are their weights. Near copies count once.
2. The lexicon is a trie. A word's Levenshtein automaton, its states as bits, steps
   along the trie's edges; branches in which no state is left are not
   followed. All words of a batch walk at once, as arrays. Terms of at least 5
   letters allow one edit, of at least 9 two; beginnings allow none.
3. Each hit gets a context score: whether it stands in quotation marks, and the
   log-odds of the ``WINDOW`` words on either side to stand around hits of toxic texts.
   The hit's evidence is its weight, less by its edits, times the chance that its
   context is abuse.
4. A logistic model of a text's whole evidence, its largest and its evidence a word gives
   the score. It is fitted on evidence by lexicons of the other half of the sample, so
   that terms that are there by chance do not count.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, the first by a hash
of the id; every text is scored whole.

Edge cases: null and empty texts have no evidence and the score of such texts;
without labelled toxic or without labelled other texts all scores are the smoothed
share; labels of null ids or null marks do not count, of several labels of one id the
largest; repeated rows get equal scores; null ids are scored like any other; of
equally near terms the heavier counts, then the first; texts of any length are read
whole; no rows give no rows; a new column whose name is in use gets underscores
until it is free.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm.common import append_columns, small_batches, written

SAMPLE_ROWS = 12_000
#: Terms of the lexicon, context words, and rows of each that come to the driver to choose from.
LEXICON, CONTEXTS, CHOICE = 400, 1000, 16_000
#: Letters of a beginning, from and up to; of a term that may be a whole word; and of those that allow one and two edits.
STEM_LETTERS, TERM_LETTERS, EDIT_LETTERS = (4, 7), (3, 24), (5, 9)
#: Texts of the sample that a term is in, at least; and hashes by which near copies leave the sample.
LEAST_TEXTS, SKETCHES = 3, 4
WINDOW = 5
#: What is assumed of hits before any is seen, and for how many hits this counts: the share of abuse in and outside quotation marks.
QUOTED_ABUSE, OPEN_ABUSE, ASSUMED_HITS = 0.2, 0.9, 20
#: Share of the weight that is left after one edit, before any is seen.
EDIT_SHARE, ASSUMED_TEXTS = 0.5, 10
RIDGE = 1e-2
#: Words that a task remembers as harmless; letters beyond which words are not held as a list.
KNOWN_WORDS, LONG_TEXT = 400_000, 1 << 22

WORD = re.compile(r"[^\W_]+")
#: Words, quotation marks and line ends.
PIECE = re.compile(r"[^\W_]+|[\"“”„«»\n]")
_WIDTH = 32


class Trie:
    """Terms that allow equally many edits; ``stems`` says that a term may go on."""

    def __init__(self, terms: Iterable[tuple[int, str]], edits: int, stems: bool = False):
        self.edits, self.stems, self.root = edits, stems, {}
        self.shortest, self.longest = 10**9, 0
        for index, term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault(None, index)
            self.shortest, self.longest = min(self.shortest, len(term)), max(self.longest, len(term))

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(word, term, edits) for every term that a word comes near enough to."""
        k = self.edits
        low, high = self.shortest - k, (10**9 if self.stems else self.longest + k)
        chosen = [i for i, w in enumerate(words) if low <= len(w) <= high]
        if not chosen or not self.root:
            return []
        cut = [words[i][:_WIDTH] for i in chosen]
        letters = np.array(cut, f"U{_WIDTH}").view(np.uint32).reshape(len(cut), _WIDTH)
        length = np.array([len(w) for w in cut], np.uint64)
        inside = (np.uint64(2) << length) - np.uint64(1)  # bits of the states 0 to length
        masks: dict[str, np.ndarray] = {}
        found: list[tuple[int, int, int]] = []
        one = np.uint64(1)

        def mask(c: str) -> np.ndarray:
            if c not in masks:
                masks[c] = np.packbits(letters == ord(c), axis=1, bitorder="little").view("<u4").ravel().astype(np.uint64)
            return masks[c]

        def walk(node: dict, alive: np.ndarray, states: list[np.ndarray]) -> None:
            for c, child in node.items():
                if c is None:
                    continue
                fits = mask(c)[alive]
                new = [(states[0] & fits) << one]
                for e in range(1, k + 1):
                    before = states[e - 1]
                    new.append(((states[e] & fits) << one) | before | (before << one) | (new[e - 1] << one))
                limit = inside[alive]
                new = [x & limit for x in new]
                left = new[0].copy()
                for x in new[1:]:
                    left |= x
                on = np.flatnonzero(left)
                if not len(on):
                    continue
                here, kept = alive[on], [x[on] for x in new]
                if None in child:
                    open_ = np.ones(len(here), bool)
                    for e, x in enumerate(kept):
                        hit = open_ if self.stems else open_ & ((x >> length[here]) & one).astype(bool)
                        found.extend((chosen[i], child[None], e) for i in here[hit].tolist())
                        open_ &= ~hit
                walk(child, here, kept)

        start = [np.full(len(cut), (2 << e) - 1, np.uint64) & inside for e in range(k + 1)]
        walk(self.root, np.arange(len(cut)), start)
        return found


@dataclass
class Lexicon:
    """Terms with their weights; a term that ends in ``*`` is a beginning."""

    terms: list[str]
    weights: list[float]
    tries: list[Trie] = field(init=False, repr=False)

    def __post_init__(self):
        numbered = list(enumerate(self.terms))
        edits = lambda t: sum(len(t) >= n for n in EDIT_LETTERS)
        whole = [(i, t) for i, t in numbered if not t.endswith("*")]
        self.tries = [Trie([(i, t[:-1]) for i, t in numbered if t.endswith("*")], 0, True), *(Trie([(i, t) for i, t in whole if edits(t) == k], k) for k in range(len(EDIT_LETTERS) + 1))]

    def lookup(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """The nearest term and its edits of each word that has one."""
        best: dict[int, tuple] = {}
        for trie in self.tries:
            for word, term, edits in trie.hits(words):
                rank = (edits, -self.weights[term], term)
                if word not in best or rank < best[word]:
                    best[word] = rank
        return {words[i]: (rank[2], rank[0]) for i, rank in best.items()}


class Reader:
    """Looks up each word of a task once, as far as memory allows."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.near, self.harmless = lexicon, {}, set()

    @staticmethod
    def words(text: str) -> tuple[set[str], int]:
        """The distinct words of a text in lower case, and how many there are in all."""
        if len(text) <= LONG_TEXT:
            all_words = WORD.findall(text)
            return set(all_words), len(all_words)
        seen, n = set(), 0
        for m in WORD.finditer(text):
            seen.add(m[0])
            n += 1
        return seen, n

    def hits(self, texts: list[str]) -> list[tuple[list[tuple[int, int, bool, list[str]]], int]]:
        """For each text its hits (term, edits, quoted, words around) and its number of words; the words of all are looked up together."""
        texts = [t.lower() for t in texts]
        read = [self.words(t) for t in texts]
        new = [w for w in set().union(*(seen for seen, _ in read)) if w not in self.harmless and w not in self.near]
        if new:
            if len(self.harmless) > KNOWN_WORDS:
                self.harmless.clear()
            found = self.lexicon.lookup(new)
            self.near.update(found)
            self.harmless.update(w for w in new if w not in found)
        near = self.near.keys()
        return [([] if seen.isdisjoint(near) else self._places(t), n) for t, (seen, n) in zip(texts, read, strict=True)]

    def _places(self, text: str) -> list[tuple[int, int, bool, list[str]]]:
        out, open_, around, last = [], False, [], []
        for m in PIECE.finditer(text):
            word = m[0]
            if word in "“„":
                open_ = True
            elif word == "”":
                open_ = False
            elif word in "\"«»":
                open_ = not open_
            elif word == "\n":
                open_ = False
            else:
                for words in last:
                    words.append(word)
                last = [w for w in last if len(w) < 2 * WINDOW + 1]
                around = around[-WINDOW:]
                if word in self.near:
                    term, edits = self.near[word]
                    # Filled from the left, so that words after the hit are told by their number.
                    mine = [""] * (WINDOW - len(around)) + [*around, word]
                    out.append((term, edits, open_, mine))
                    last.append(mine)
                around.append(word)
        return [(t, e, q, [w for i, w in enumerate(words) if w and i != WINDOW and w not in self.near]) for t, e, q, words in out]


@dataclass
class Model:
    lexicon: Lexicon
    edit_share: list[float]
    quoted: float  # logits of abuse in and outside quotation marks
    open: float
    contexts: dict[str, float]
    coefficients: np.ndarray

    def evidence(self, hits: list, n_words: int, lexicon: Lexicon | None = None) -> np.ndarray:
        """Whole evidence, the largest, and evidence for each hundred words, on a scale of logarithms."""
        weights = (lexicon or self.lexicon).weights
        total = most = 0.0
        for term, edits, quoted, around in hits:
            logit = (self.quoted if quoted else self.open) + sum(self.contexts.get(w, 0.0) for w in set(around))
            one = weights[term] * self.edit_share[edits] / (1 + np.exp(-np.clip(logit, -6, 6)))
            total, most = total + one, max(most, one)
        return np.array([np.log1p(total), most, np.log1p(100 * total / max(n_words, 1))])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + evidence @ self.coefficients[1:], -30, 30)))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def surprise(a, b, share: float, log=np.log, largest=np.maximum):
    """Minus the logarithm of a bound of the chance of ``a`` toxic texts or more among ``a + b``, where toxic ones have this share."""
    n = a + b
    return a * log(a / (n * share)) + b * log(largest(b, 1e-9) / (n * (1 - share)))


def choose(rows: list[tuple[str, int, int]], n_toxic: int, n_other: int, n_terms: int, limit: int = LEXICON) -> Lexicon:
    """The most telling of rows (term, toxic texts, other texts), of which chance would bring less than one among ``n_terms``.

    None is chosen that a chosen beginning covers, and no beginning that a chosen term makes up.
    """
    share, enough = n_toxic / max(n_toxic + n_other, 1), np.log(max(n_terms, 1))

    def weight(a: int, b: int) -> float:
        return float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1)))

    told = [(t, a, b, float(surprise(a, b, share))) for t, a, b in rows if a + b >= LEAST_TEXTS and a > share * (a + b)]
    ranked = sorted(((told_by, t, a, weight(a, b)) for t, a, b, told_by in told if told_by > enough), key=lambda x: (-round(x[0], 9), x[1].endswith("*"), -len(x[1]), x[1]))
    chosen: list[tuple[str, float, int]] = []
    stems: set[str] = set()
    inner: dict[str, int] = {}  # a beginning -> the most texts of a chosen term that begins with it
    for _, term, a, w in ranked:
        plain = term.rstrip("*")
        if len(chosen) == limit:
            break
        if any(plain[:j] in stems for j in range(STEM_LETTERS[0], len(plain) + 1)):
            continue
        if term != plain:
            if inner.get(plain, 0) >= 0.9 * a:
                continue
            stems.add(plain)
        chosen.append((term, w, a))
        for j in range(1, len(plain) + 1):
            inner[plain[:j]] = max(inner.get(plain[:j], 0), a)
    return Lexicon([t for t, _, _ in chosen], [w for _, w, _ in chosen])


def one_of_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, ...) without those whose least hashes of three-word shingles equal a smaller id's, by two of ``SKETCHES`` hashes.

    One equal hash alone may be that of a passage that many texts share.
    """

    def compute():
        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            made = []
            for text in rows.column(rows.schema.names.index("text")):
                words = np.array([xxhash.xxh64_intdigest(w) for w in WORD.findall((text.as_py() or "").lower())], np.uint64)
                runs = words.copy()
                for j in (1, 2):
                    runs = runs[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[j:] if len(runs) > 1 else runs
                made.append([int(((runs ^ runs >> np.uint64(31)) * np.uint64((2 * i + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1) >> np.uint64(1)).min()) if len(runs) else 0 for i in range(SKETCHES)])
            return [pa.array(made, pa.list_(pa.int64()))]

        return batch

    sketched = append_columns(rows, [T.StructField("sketch", T.ArrayType(T.LongType()))], compute)
    for pair in itertools.combinations(range(SKETCHES), 2):
        first = F.row_number().over(Window.partitionBy("print").orderBy("doc_id"))
        sketched = sketched.withColumn("print", F.array(*[F.get("sketch", i) for i in pair])).withColumn("at", first).where("at = 1 or length(text) = 0").drop("print", "at")
    return sketched.drop("sketch")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, a0, b0, a1, b1): toxic and other texts of each half that have a word, or with ``*`` a beginning; of rows (half, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}

        def flush() -> pa.RecordBatch:
            terms = list(set().union(*held.values()))
            made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([held[h, y][t] for t in terms], pa.int64()) for h in (0, 1) for y in (1, 0))], ["term", "a0", "b0", "a1", "b1"])
            for c in held.values():
                c.clear()
            return made

        low, high = STEM_LETTERS
        for batch in batches:
            for half, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, _ = Reader.words((text or "").lower())
                stems = {w[:j] + "*" for w in seen for j in range(low, min(high, len(w) - 1) + 1)}
                held[half, label].update(w for w in seen if TERM_LETTERS[0] <= len(w) <= TERM_LETTERS[1])
                held[half, label].update(stems)
            if sum(map(len, held.values())) > KNOWN_WORDS:
                yield flush()
        yield flush()

    found = rows.select("half", "label", "text").mapInArrow(run, "term string, a0 long, b0 long, a1 long, b1 long")
    return found.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")])


def by_other_half(readers: list[Reader], batch: pa.RecordBatch) -> Iterator[tuple[int, int, list, int]]:
    """(row, label, hits, number of words) of rows (half, label, text), each read by its half's reader."""
    halves, labels, texts = (c.to_pylist() for c in batch.columns[:3])
    for half, reader in enumerate(readers):
        mine = [i for i, h in enumerate(halves) if h == half]
        for i, (hits, n) in zip(mine, reader.hits([texts[i] or "" for i in mine]), strict=True):
            yield i, labels[i], hits, n


def hit_rows(rows: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """(kind, word, a, b) of rows (half, label, text) by the other half's lexicon: counts of toxic and other.

    Kinds: ``edits`` texts by the least edits of their hits, ``marks`` hits in (1) and
    outside (0) quotation marks, ``around`` hits that a word stands near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in lexicons]
        counts: Counter = Counter()
        for batch in batches:
            for _, label, hits, _ in by_other_half(readers, batch):
                if hits:
                    counts["edits", str(min(e for _, e, _, _ in hits)), label] += 1
                for _, _, quoted, around in hits:
                    counts["marks", str(int(quoted)), label] += 1
                    counts.update(("around", w, label) for w in set(around))
        keys = list({k[:2] for k in counts})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), *(pa.array([counts[k, w, y] for k, w in keys], pa.int64()) for y in (1, 0))], ["kind", "word", "a", "b"])

    found = rows.select("half", "label", "text").mapInArrow(run, "kind string, word string, a long, b long")
    return found.groupBy("kind", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, the constant first, by Newton's steps with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    at, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ at)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return at


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows for which ``held_out``, a function from the id column to a condition, is false.

    The ids of the sample are broadcast, ``SAMPLE_ROWS`` at most; the sample's texts are written once.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    chosen = marked.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half")
    texts = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", half, "label", "text"), "toxicity-texts")
    sample = written(one_of_copies(texts).select("half", "label", "text"), "toxicity-sample")
    sizes = {(r["half"], r["label"]): r["n"] for r in sample.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}  # four rows at most
    n_of = lambda y, *halves: sum(sizes.get((h, y), 0) for h in halves)
    toxic, other = n_of(1, 0, 1), n_of(0, 0, 1)
    empty = Lexicon([], [])
    if not toxic or not other:
        return Model(empty, [1.0] * 3, 0.0, 0.0, {}, np.array([logit((toxic + 0.5) / (toxic + other + 2)), 0.0, 0.0, 0.0]))

    # The most telling terms; the exact choice among them is the driver's, of CHOICE rows at most.
    counts = written(term_counts(sample).withColumn("a", F.col("a0") + F.col("a1")).withColumn("b", F.col("b0") + F.col("b1")).where(F.col("a") + F.col("b") >= LEAST_TEXTS), "toxicity-terms")
    n_terms, part = counts.count(), toxic / (toxic + other)
    told = surprise(F.col("a"), F.col("b"), part, F.log, lambda x, least: F.greatest(x, F.lit(least)))
    rows = counts.where(F.col("a") > part * (F.col("a") + F.col("b"))).orderBy(F.desc(told), "term").limit(CHOICE).collect()
    whole = choose([(r["term"], r["a"], r["b"]) for r in rows], toxic, other, n_terms)
    others = [choose([(r["term"], r[f"a{h}"], r[f"b{h}"]) for r in rows], n_of(1, h), n_of(0, h), n_terms) for h in (1, 0)]

    seen = hit_rows(sample, others)
    told = {(r["kind"], r["word"]): (r["a"], r["b"]) for r in seen.where("kind <> 'around'").collect()}  # two marks and three edits
    marks = lambda w: told.get(("marks", w), (0, 0))
    share = lambda ab, assumed: logit((ab[0] + assumed * ASSUMED_HITS) / (sum(ab) + ASSUMED_HITS))
    hits_toxic, hits_other = (marks("0")[i] + marks("1")[i] for i in (0, 1))
    contexts: dict[str, float] = {}
    if hits_toxic and hits_other:  # else contexts tell nothing
        base = float(np.clip(hits_toxic / (hits_toxic + hits_other), 0.05, 0.95))
        around = seen.where("kind = 'around' and a + b >= 5").orderBy(F.desc(F.col("a") + F.col("b")), "word").limit(CONTEXTS).collect()
        contexts = {r["word"]: float(np.clip(logit((r["a"] + base * ASSUMED_HITS) / (r["a"] + r["b"] + ASSUMED_HITS)) - logit(base), -3, 3)) for r in around}
    odds = lambda ab: float(np.log((ab[0] + 1) / (toxic + 2)) - np.log((ab[1] + 1) / (other + 2)))
    exact, shares = max(odds(told.get(("edits", "0"), (0, 0))), 0.1), [1.0]
    for e in (1, 2):
        ab = told.get(("edits", str(e)), (0, 0))
        mean = (sum(ab) * odds(ab) + ASSUMED_TEXTS * EDIT_SHARE**e * exact) / (sum(ab) + ASSUMED_TEXTS)
        shares.append(float(np.clip(mean / exact, 0, 1)))
    model = Model(whole, shares, share(marks("1"), QUOTED_ABUSE), share(marks("0"), OPEN_ABUSE), contexts, np.zeros(4))

    def compute():
        readers = [Reader(x) for x in others]

        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            made: list = [None] * rows.num_rows
            halves = rows.column(0).to_pylist()
            for i, _, hits, n in by_other_half(readers, rows):
                made[i] = model.evidence(hits, n, others[halves[i]]).tolist()
            return [pa.array(made, pa.list_(pa.float64()))]

        return batch

    fitted = append_columns(sample, [T.StructField("evidence", T.ArrayType(T.DoubleType()))], compute).select("label", "evidence").collect()  # SAMPLE_ROWS at most
    fitted.sort(key=lambda r: (r["evidence"], r["label"]))
    model.coefficients = logistic(np.array([r["evidence"] for r in fitted]), np.array([float(r["label"]) for r in fitted]))
    return model


def score(frame: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``frame`` with the score of each text; other columns stay."""
    small_batches(frame.sparkSession)

    def compute():
        reader = Reader(model.lexicon)

        def batch(rows: pa.RecordBatch) -> list[pa.Array]:
            column = rows.column(rows.schema.names.index(text))
            found = np.array([model.evidence(*x) for x in reader.hits([x.as_py() or "" for x in column])]).reshape(-1, 3)
            return [pa.array(model.score(found), pa.float64())]

        return batch

    return append_columns(frame, [T.StructField(output, T.DoubleType())], compute)
