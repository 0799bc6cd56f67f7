"""Phrases whose words come together more often than their parts would, by pivot partitioning.

1. Texts become blocks of bounded size of one language each, compressed; pieces stay
   whole. Words are counted with the blocks that have them; frequent ones get numbers,
   and each block gets the numbers and counts of its own, so no task holds a dictionary
   of the corpus. From then on a block is a row of ranks.
2. Neighbouring frequent words go to one of the parts by the sum of their numbers, all
   pairs of a block and part in one row of compressed columns, so that every pair is
   counted in one place however often it occurs. Blocks get back the frequent pairs that
   they have, a row for each part.
3. In a block each word of such pairs stands as pivot for what it may own: up to four
   words before it that are more frequent, and up to four after it that are not rarer, as
   far as neighbours are frequent pairs. Equal such fragments of a block are one row of a
   matrix, with a count; a part gets one matrix of a block. The pivot of a phrase is thus
   the first place of its rarest word, and each occurrence has one. A pivot's part counts
   all phrases of three words or more that go through the pivot's place; those under
   ``SUPPORT`` stay there. Pivots of more than ``HOT`` occurrences are dealt out by the word
   before the pivot, for phrases that have one, and by the word after it for those that
   begin with the pivot, so that each phrase is still counted in one place.
4. Numbers become words again. Cuts meet the counts of both parts, which are frequent as
   well, by joins; the scores are decimals without a fraction. Phrases that a longer one
   explains go by a join on the longer one's parts.

Numbers of words are below 2^31, so that a pair fits into 64 bits.

Edge cases: null text is empty, null lang ``und``; repeated rows count each; words
between separators alone make a piece; texts of any length are read whole and
are dealt to several blocks between two pieces; ties are broken by the phrase's UTF-8 bytes;
only lang and text are read, so that no other column can clash; no rows give no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import give_back, small_batches, utf8, written

SUPPORT, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Bytes of a block, and occurrences of a pivot beyond which its fragments are dealt out.
BLOCK_BYTES, HOT = 4 << 20, 100_000
#: Parts that pairs and pivots are dealt to, at least; words of the corpus for each beyond; words of blocks that a task holds before it sends them.
PARTS, PART_WORDS, HELD = 32, 1 << 21, 2_000_000

# A-Z in lower case; a zero byte, which ends a piece as a line end does, stays itself as part of words.
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_PIECES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in _LOWER)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, byte by byte of their value, compressed."""
    table = np.stack([c.astype("<i8") for c in columns]).view(np.uint8).reshape(len(columns), -1, 8)
    return zstandard.compress(table.transpose(0, 2, 1).tobytes(), 3)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    """The matrix of what ``packed`` has made of so many columns."""
    table = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(table.transpose(0, 2, 1)).view("<i8")[:, :, 0]


def cuts(*columns: np.ndarray) -> list[int]:
    """Where the runs of equal rows begin, and the end."""
    n = len(columns[0])
    changes = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        changes |= c[1:] != c[:-1]
    return [*([0] if n else []), *(np.flatnonzero(changes) + 1).tolist(), n]


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, a place of each, and the sum of its counts."""
    order = np.argsort(codes, kind="stable")
    first = np.array(cuts(codes[order])[:-1], np.int64)
    return codes[order[first]], order[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(lang, data, n): pieces of one language, ended by line ends, in lower case, of about ``size`` bytes, compressed, and their words' number."""
    names = ["lang", "data", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[bytes], int]] = {}

        def block(lang: str) -> pa.RecordBatch:
            data = b"\n".join(held.pop(lang)[0])
            n = sum(map(bool, data.replace(b"\n", b" ").split(b" ")))
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([zstandard.compress(data, 3)], pa.binary()), pa.array([n], pa.int64())], names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                text, at = text.translate(_PIECES), 0
                while at < len(text):
                    end = len(text)
                    if end - at > size:  # a long text goes on after a piece
                        end = text.rfind(b"\n", at, at + size) + 1 or text.find(b"\n", at + size) + 1 or end
                    parts, have = held.get(lang, ([], 0))
                    parts.append(text[at:end])
                    held[lang] = (parts, have + end - at)
                    if held[lang][1] >= size:
                        yield block(lang)
                    at = end
            if sum(n for _, n in held.values()) > 4 * size:  # many languages, each with little
                yield block(max(held, key=lambda x: held[x][1]))
        for lang in list(held):
            yield block(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, data binary, n long")


def tokens(data: bytes) -> list[bytes]:
    """A block's words, with line ends between pieces; blanks leave empty ones."""
    return zstandard.decompress(data).replace(b"\n", b" \n ").split(b" ")


def counted(data: bytes) -> Counter:
    """A block's words in the order of their first places, with their counts."""
    words = Counter(tokens(data))
    words.pop(b"", None)
    words.pop(b"\n", None)
    return words


def asked_words(found: DataFrame) -> DataFrame:
    """(block, lang, word, at, n): the words of each block, each with its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = counted(data)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(words), pa.int64()), pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(range(len(words)), pa.int32()), pa.array(list(words.values()), pa.int64())], ["block", "lang", "word", "at", "n"])

    return found.select("block", "lang", "data").mapInArrow(run, "block long, lang string, word string, at int, n long")


def frequent_words(asked: DataFrame, support: int) -> DataFrame:
    """(id, lang, word, f, places): words of at least ``support`` occurrences, with numbers from 0, and struct(block, at) for each block that has them."""
    words = asked.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.collect_list(F.struct("block", "at")).alias("places")).where(F.col("f") >= support)
    words = written(words.withColumn("row", F.monotonically_increasing_id()), "frequent-words")
    # The rows of a task are numbered by themselves; a row for each task tells how many are before it.
    words = words.withColumn("task", F.shiftright("row", 33))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = words.groupBy("task").count().select("task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    return words.join(F.broadcast(begins), "task").select((F.col("begin") + F.col("row") - F.shiftleft("task", 33)).alias("id"), "lang", "word", "f", "places")


def known_words(words: DataFrame) -> DataFrame:
    """(block, known): for each block the places, numbers and counts of its frequent words, in several packed parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            block, at, number, f = np.concatenate(held, 1)
            held.clear()
            order = np.argsort(block, kind="stable")
            block, at, number, f = block[order], at[order], number[order], f[order]
            ends = cuts(block)
            rows = [packed(at[a:b], np.diff(number[a:b], prepend=0), f[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(block[ends[:-1]]), pa.array(rows, pa.binary())], ["block", "known"])

        for batch in batches:
            lists = batch.column(2)
            lengths, values = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
            held.append(np.stack([values.field("block").to_numpy(), values.field("at").to_numpy().astype(np.int64), *(np.repeat(batch.column(i).to_numpy(), lengths) for i in (0, 1))]))
            if sum(x.shape[1] for x in held) > HELD:
                yield flush()
        if held:
            yield flush()

    return words.select("id", "f", "places").mapInArrow(run, "block long, known binary").groupBy("block").agg(F.collect_list("known").alias("known"))


def coded_blocks(rows: DataFrame) -> DataFrame:
    """(block, words, places) of rows (block, data, known): numbers and counts of a block's frequent words, the most frequent first, and its text as ranks from 1 among them, with 0 for a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, data, known = (batch.column(j)[i].as_py() for j in range(3))
                parts = [unpacked(x, 3) for x in known]
                at, number, f = (np.concatenate(c) for c in zip(*((a, np.cumsum(d), f) for a, d, f in parts), strict=True))
                order = np.lexsort((number, -f))
                texts = tokens(data)
                index = dict.fromkeys(texts)
                index.pop(b"", None)
                index.pop(b"\n", None)
                ranks = np.zeros(len(index), np.int64)
                ranks[at[order]] = np.arange(1, len(order) + 1)
                index = dict(zip(index, ranks.tolist(), strict=True))
                index[b"\n"], index[b""] = 0, -1
                places = np.array([index[w] for w in texts], np.int32)
                places = places[places >= 0]
                # A word between two gaps, and a gap after another, say nothing.
                has = np.concatenate([[False], places > 0, [False]])
                places = np.where(has[:-2] | has[2:], places, 0)
                places = places[(places > 0) | np.concatenate([[False], places[:-1] > 0])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed(number[order], f[order])], pa.binary()), pa.array([packed(places)], pa.binary())], ["block", "words", "places"])
            give_back()

    return rows.select("block", "data", "known").mapInArrow(run, "block long, words binary, places binary")


def pair_rows(coded: DataFrame, parts: int) -> DataFrame:
    """(part, block, pairs): for each part of a block its pairs of neighbours, with their numbers of occurrences.

    A pair is in the part of the sum of its words' numbers, so that the second word's number need only be told as its multiple of ``parts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, places = unpacked(words, 2)[0], unpacked(data, 1)[0]
                one, two = places[:-1], places[1:]
                both = (one > 0) & (two > 0)
                codes, n = np.unique(one[both] << 32 | two[both], return_counts=True)
                one, two = number[(codes >> 32) - 1], number[(codes & 0xFFFFFFFF) - 1]
                part = (one + two) % parts
                order = np.lexsort((two, one, part))
                one, two, part, n = one[order], two[order] // parts, part[order], n[order]
                ends = cuts(part)
                rows = [packed(np.diff(one[a:b], prepend=0), two[a:b], n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(part[ends[:-1]].astype(np.int32)), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["part", "block", "pairs"])
            give_back()

    return coded.select("block", "words", "places").mapInArrow(run, "part int, block long, pairs binary")


def mined_pairs(dealt: DataFrame, parts: int, support: int) -> DataFrame:
    """(block, pairs) of rows in the order of their parts: the frequent pairs of a part with their counts, for null, and those that each block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = -1, []

        def close() -> Iterator[pa.RecordBatch]:
            codes, n = np.concatenate([c for _, c, _ in held]), np.concatenate([n for _, _, n in held])
            found, _, sums = summed(codes, n)
            kept, sums = found[sums >= support], sums[sums >= support]
            rows: list[tuple[int | None, bytes]] = [(None, packed(kept >> 32, kept & 0xFFFFFFFF, sums))] if len(kept) else []
            for block, codes, _ in held if len(kept) else ():
                has = codes[kept[np.minimum(np.searchsorted(kept, codes), len(kept) - 1)] == codes]
                if len(has):
                    rows.append((block, packed(np.diff(has >> 32, prepend=0), (has & 0xFFFFFFFF) // parts, np.array([own] * len(has)))))
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["block", "pairs"])

        for batch in batches:
            for part, block, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != own and held:
                    yield from close()
                own = part
                one, two, n = unpacked(pairs, 3)
                one = np.cumsum(one)
                held.append((block, one << 32 | two * parts + (part - one) % parts, n))
        if held:
            yield from close()

    return dealt.select("part", "block", "pairs").mapInArrow(run, "block long, pairs binary")


def numbers(rows: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Matrices of words' numbers, each row a phrase, as lists with their counts."""
    lengths = np.concatenate([np.full(len(r), r.shape[1]) for r in rows])
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r.ravel() for r in rows]).astype(np.int64)))
    return pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate(counts))], ["ids", "n"])


def pair_numbers(pairs: DataFrame) -> DataFrame:
    """(ids, n) of the packed frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                one, two, n = unpacked(data, 3)
                yield numbers([np.stack([one, two], 1)], [n])

    return pairs.select("pairs").mapInArrow(run, "ids array<long>, n long")


def windows(places: np.ndarray, linked: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place its fragment, a row of ``2 * reach + 1`` ranks around it with 0 for none; and which have three words or more.

    Ranks count from 1, the most frequent word; 0 is another word or the end of
    a piece. ``linked`` says which places go on to the next. Before the pivot only
    smaller ranks go on, after it smaller or equal ones.
    """
    n = len(places)
    blank = np.zeros(reach + 1, np.int32)
    framed, links = np.concatenate([blank, places, blank]), np.concatenate([blank, linked, blank]).astype(bool)
    out = np.zeros((n, 2 * reach + 1), np.int32)
    out[:, reach] = places
    for side in (-1, 1):
        going = places > 0
        for j in range(1, reach + 1):
            at = reach + 1 + side * j
            near, link = framed[at : at + n], links[min(at, at - side) :][:n]
            going = going & link & (near > 0) & ((near < places) if side < 0 else (near <= places))
            out[:, reach + side * j] = np.where(going, near, 0)
    return out, (out > 0).sum(1) > 2


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of ranks and how often each is there."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order = np.lexsort(rows.T)
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[first], np.diff(np.concatenate([first, [len(rows)]]))


def fragments(number: np.ndarray, f: np.ndarray, places: np.ndarray, pairs: np.ndarray, longest: int, hot: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block, given its frequent pairs: rows of words' numbers from 1 around a pivot, 0 for none; how often each is there; which have only what goes on before the pivot; their parts."""
    reach = longest - 1
    one, two = places[:-1], places[1:]
    linked = np.zeros(len(places), bool)
    both = np.flatnonzero((one > 0) & (two > 0))
    linked[both] = np.isin(number[one[both] - 1] << 32 | number[two[both] - 1], pairs)
    around, has = windows(places.astype(np.int32), linked, reach)
    rows, n = distinct_rows(around[has])
    is_hot = f[rows[:, reach] - 1] > hot
    before = is_hot & (rows[:, reach - 1] > 0)
    after = is_hot & (rows[:, reach + 2] > 0) if reach > 1 else is_hot & False
    alone = rows[after].copy()  # phrases that begin with the pivot
    alone[:, :reach] = 0
    rows, n = np.concatenate([rows[~is_hot], rows[before], alone]), np.concatenate([n[~is_hot], n[before], n[after]])
    only = np.zeros(len(rows), bool)
    only[(~is_hot).sum() : (~is_hot).sum() + before.sum()] = True
    rows = np.concatenate([[0], number + 1])[rows]
    part = rows[:, reach].copy()
    part[only] += rows[only, reach - 1]
    last = slice(len(rows) - len(alone), None)
    part[last] += rows[last, reach + 1]
    return rows, n, only, part % parts


def fragment_rows(rows: DataFrame, longest: int, hot: int, parts: int) -> DataFrame:
    """(part, rows) of rows (words, places, pairs), one to a block: the fragments of the pivots of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, data, pairs = (batch.column(j)[i].as_py() for j in range(3))
                (number, f), places = unpacked(words, 2), unpacked(data, 1)[0]
                codes = []
                for one, two, own in (unpacked(x, 3) for x in pairs):
                    one = np.cumsum(one)
                    codes.append(one << 32 | two * parts + (own - one) % parts)
                found, n, only, part = fragments(number, f, places, np.concatenate(codes), longest, hot, parts)
                order = np.lexsort((*found.T, part))
                found, n, only, part = found[order], n[order], only[order], part[order]
                ends = cuts(part)
                made = [packed(*found[a:b].T, n[a:b], only[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(part[ends[:-1]].astype(np.int32)), pa.array(made, pa.binary())], ["part", "rows"])
            give_back()

    return rows.select("words", "places", "pairs").mapInArrow(run, "part int, rows binary")


def mined(dealt: DataFrame, support: int, longest: int) -> DataFrame:
    """(ids, n), of three words or more and at least ``support`` occurrences, of rows in the order of their parts."""
    reach = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = -1, []

        def close() -> Iterator[pa.RecordBatch]:
            table = np.concatenate(held, 1)
            held.clear()
            n, only = table[-2], table[-1] > 0
            used, dense = np.unique(table[:-2], return_inverse=True)
            dense = dense.reshape(table.shape[0] - 2, -1)
            there = table[:-2] > 0
            rows, counts = [], []
            for i in range(reach + 1):
                for j in range(max(0, 2 - i), reach - i + 1):
                    at = np.flatnonzero(there[reach - i] & there[reach + j] & ~(only & (i == 0)))
                    code = dense[reach - i, at]
                    for column in range(reach - i + 1, reach + j + 1):
                        _, code = np.unique(code * len(used) + dense[column, at], return_inverse=True)
                    _, first, sums = summed(code, n[at])
                    kept = at[first[sums >= support]]
                    if len(kept):
                        rows.append(table[reach - i : reach + j + 1, kept].T - 1)
                        counts.append(sums[sums >= support])
            if rows:
                yield numbers(rows, counts)

        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != own and held:
                    yield from close()
                own = part
                held.append(unpacked(data, 2 * reach + 3))
        if held:
            yield from close()

    return dealt.select("part", "rows").mapInArrow(run, "ids array<long>, n long")


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, n) of rows (ids, n), each list once."""
    parts = found.select("ids", "n", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    joined = parts.groupBy("ids", "n").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    return joined.select("lang", F.array_join("parts.word", " ").alias("phrase"), "n")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, n) of at least ``support`` occurrences: single words, phrases of 2 to ``longest`` words; and (lang, n) of all words."""
    small_batches(docs.sparkSession)
    found = written(blocks(docs, block_bytes).withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")
    totals = written(found.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    parts = max(PARTS, (totals.agg(F.sum("n")).first()[0] or 0) // PART_WORDS)
    words = frequent_words(asked_words(found), support)
    coded = written(coded_blocks(found.join(known_words(words), "block")), "coded-blocks")
    pairs = written(mined_pairs(pair_rows(coded, parts).repartition("part").sortWithinPartitions("part"), parts, support), "frequent-pairs")

    phrases = pair_numbers(pairs.where("block is null"))
    if longest > 2:
        asks = pairs.where("block is not null").groupBy("block").agg(F.collect_list("pairs").alias("pairs"))
        dealt = fragment_rows(coded.join(asks, "block"), longest, hot, parts)
        phrases = phrases.unionByName(mined(dealt.repartition("part").sortWithinPartitions("part"), support, longest))
    phrases = written(phrases, "phrase-numbers")
    return words.select("lang", F.col("word").alias("phrase"), F.col("f").alias("n")), written(spelled(phrases, words), "frequent-phrases"), totals


def scored(words: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): each phrase by its lowest-scoring cut, the first of them."""
    counts = words.unionByName(phrases)
    parts = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), parts.alias("ws"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws")), " ").alias("right"))
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    # One row to a language; a language is bounded by its phrases' own count in what it joins.
    met = met.join(F.broadcast(totals), "lang") if totals.limit(100_001).count() <= 100_000 else met.join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    products = met.withColumn("over", (whole("a") * whole("n")) * F.lit(1000).cast("decimal(4,0)")).withColumn("under", whole("l") * whole("r"))
    lowest = products.withColumn("score", F.expr("over div under").cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def explained(phrases: DataFrame, share: int) -> DataFrame:
    """(lang, phrase): phrases inside a longer one that has at least ``share`` in a hundred of their occurrences."""
    ws = phrases.select("lang", "n", F.split("phrase", " ").alias("ws"))
    lengths = F.sequence(F.lit(2), F.size("ws") - 1)
    runs = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("ws") - m + 1), lambda i: F.array_join(F.slice("ws", i, m), " "))))
    inner = ws.where(F.size("ws") > 2).select("lang", "n", F.explode(F.array_distinct(runs)).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return phrases.join(longest, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("n") * share).select("lang", "phrase")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, share: int = SHARE, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    words, phrases, totals = frequent_phrases(docs, support, longest, block_bytes, hot)
    kept = scored(words, phrases, totals).join(explained(phrases, share), ["lang", "phrase"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
