"""How far the sources of a language differ in their use of words, in whole numbers.

1. Terms are counted for each (lang, source) group, with a row for each group
   even without terms; a task adds up what it has read before the shuffle.
2. Each language keeps the terms that at least ``MIN_DOCUMENTS`` of its rows have
   and deals them to blocks, so that groups times terms of a block are at most
   about ``CELLS``.
3. A block is a dense tile of 64-bit counts, groups by terms. It gives the shares
   p of every cell, the sums over its terms of floor((p - q)^2 / q) for all pairs
   of groups by broadcasting, and for each group its first ``TOP`` terms against
   the language.
4. Partial pair matrices are summed and the groups' first terms merged.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)), by long division in base 1000,
so that no product leaves 64 bits while N + V is under 9 * 10^15. As the shares of a group
sum to about 10^9 + V, so do all sums of squares.

Edge cases: null lang, source and text are empty strings, and a group of them is a
group; repeated rows count each; a language without kept terms gives its pairs
with value 0 and no term rows; a language of one source has no pairs; ties go to
the smaller item by its UTF-8 bytes; texts of any length are read whole; only
lang, source and text are read, so that no other column can clash; no rows give
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import small_batches, utf8, written

MIN_DOCUMENTS, TOP, UNIT = 3, 200, 1_000_000_000
#: Groups times terms of a tile, and entries that a task counts before it passes them on.
CELLS, HELD_TERMS = 1 << 18, 300_000
#: Languages whose sizes go to every task by broadcast (some 50 bytes each); more are dealt over ``SALTS`` parts.
BROADCAST_LANGUAGES, SALTS = 100_000, 64

# Letters of ASCII, in lower case, and all bytes beyond ASCII stay; the rest parts terms.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows; a null term stands for the group itself."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        names = ["lang", "source", "term", "n", "docs"]

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (all_terms, rows) in held.items():
                terms = [None, *all_terms]
                n = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *all_terms.values()], pa.int64()), pa.array([0, *[rows[t] for t in all_terms]], pa.int64())], names
                )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                all_terms, rows = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(_FOLD).split()
                all_terms.update(words)
                rows.update(set(words))
            if sum(len(x) for x, _ in held.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    found = docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def with_sizes(frame: DataFrame, sizes: DataFrame) -> DataFrame:
    """``frame`` with its language's sizes; a common language is dealt out where they can't be broadcast."""
    if sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        return frame.join(F.broadcast(sizes), "lang")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = [c for c in ("term", "source") if c in frame.columns][0]
    return frame.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), the quotient's digits in base 1000 one by one."""
    rest, digits = counts + 1, np.zeros_like(counts)
    for scale in (1, 1000, 1000, 1000):
        rest = rest * scale
        digits = digits * scale + rest // total
        rest = rest % total
    return 1 + digits


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), of whole numbers."""
    away = p - q
    return away * away // q


def tile(terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """(lang, source, part, item, value) of one block: all pairs' partial sums, and each group's first terms."""
    names, totals = groups.column("source").combine_chunks(), groups.column("total").to_numpy()
    order = np.array(sorted(range(len(names)), key=lambda i: names[i].as_py().encode()))
    names, totals = names.take(pa.array(order)), totals[order]
    lang, kept, n = groups.column("lang")[0].as_py(), groups.column("kept")[0].as_py(), len(names)
    words, cells = terms.column("term").combine_chunks(), terms.column("cells").combine_chunks()
    words = words.cast(pa.binary())
    at = np.array(pc.sort_indices(words)) if len(words) else np.zeros(0, np.int64)
    words = words.take(pa.array(at, pa.int64()))
    column = np.empty(len(at), np.int64)
    column[at] = np.arange(len(at))
    counts = np.zeros((n, len(at)), np.int64)
    flat = cells.flatten()
    if len(flat):
        row = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False)
        counts[row, np.repeat(column, pc.list_value_length(cells).to_numpy(zero_copy_only=False))] = flat.field("n").to_numpy()
    p = shares(counts, (totals + kept)[:, None]) if len(at) else counts
    q = shares(counts.sum(0), np.array(totals.sum() + kept)) if len(at) else np.zeros(0, np.int64)

    sums = np.stack([excess(p[g], p).sum(1) for g in range(n)]) if n else np.zeros((0, 0), np.int64)
    one, other = np.nonzero(~np.eye(n, dtype=bool))
    sources, items, values = [one], [names.take(pa.array(other))], [sums[one, other]]
    n_pairs = len(one)
    for g in range(n):
        mine = np.flatnonzero((counts[g] > 0) & (p[g] > q))
        value = excess(p[g, mine], q[mine])
        if len(mine) > top:  # what may tie with the last stays until all are in order
            near = value >= np.partition(value, len(mine) - top)[len(mine) - top]
            mine, value = mine[near], value[near]
        best = np.lexsort((mine, -value))[:top]
        sources.append(np.full(len(best), g))
        items.append(words.take(pa.array(mine[best], pa.int64())).cast(pa.string()))
        values.append(value[best])
    source = names.take(pa.array(np.concatenate(sources), pa.int64()))
    part = pa.array(["pair"] * n_pairs + ["term"] * (len(source) - n_pairs), pa.string())
    return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": source, "part": part, "item": pa.concat_arrays(items), "value": pa.array(np.concatenate(values), pa.int64())})


def divergences(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against each other source, and its own terms against the language."""
    small_batches(docs.sparkSession)
    found = written(counted(docs), "term-counts")
    listed = found.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    terms = written(listed.where(F.col("docs") >= min_documents).drop("docs"), "kept-terms")
    totals = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = found.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    width = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("n_groups")))
    sizes = written(sizes.select("lang", "kept", F.greatest(F.lit(1), F.ceil(F.col("kept") / width)).alias("blocks")), "language-sizes")
    dealt = with_sizes(terms, sizes).withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).select("lang", "block", "term", "cells")
    axes = with_sizes(groups, sizes).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("lang", "block", "source", "total", "kept")
    schema = "lang string, source string, part string, item string, value long"
    parts = written(dealt.groupBy("lang", "block").cogroup(axes.groupBy("lang", "block")).applyInArrow(lambda a, b: tile(a, b, top), schema), "divergence-parts")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    firsts = parts.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.unionByName(firsts)
