"""A tree of digests over keyed rows, by which two tables are compared without reading what is equal.

A key's place is the beginning of its hash, ``depth`` hexadecimal digits, so that leaves
are of even size whatever the keys are. A leaf's digest is made of sums over the
digests of its rows, which need no order and are added up before the shuffle; an
inner node's is made of its sixteen children at most. The rows' own digests are
kept beside the tree in the order of their leaves.

``diff`` goes down from the root through unequal nodes alone and reads the rows of
unequal leaves: for k changed keys about ``16 * k * depth`` nodes and k leaves.

Rows without a key are left out. Rows that share a key count together, with their
number. Null differs from any text. Columns are compared as their strings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import settled

#: Unequal leaves up to this number are named to the scan, which skips the row groups of others; more are joined.
NAMED_LEAVES = 1000


def _sums(digest: str) -> list[Column]:
    """The eight 32-bit words of a digest, added up; no sum overflows below 2 billion rows."""
    return [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]


def _words() -> Column:
    return F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(8)], F.col("n").cast("string"))


def keyed_digests(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, digest): one digest for all rows of a key, whatever their order."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in columns]
    one = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.sha2(F.concat(*told) if told else F.lit(""), 256).alias("digest"))
    whole = one.groupBy("key").agg(*_sums("digest"), F.count("*").alias("n"))
    return whole.select("key", F.sha2(F.concat_ws("|", F.col("key").cast("string"), _words()), 256).alias("digest"))


class DigestTree:
    """The written digests below ``root``: ``rows`` (leaf, key, digest), ``nodes`` (level, path, digest, n) and ``shape`` (depth)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, root.rstrip("/")

    def build(self, rows: DataFrame, key: str, columns: Sequence[str], depth: int = 3) -> DigestTree:
        """Deeper trees have smaller leaves: a sixteenth for each level."""
        self.spark.range(1).select(F.lit(depth).alias("depth")).write.parquet(f"{self.folder}/shape")
        keyed = keyed_digests(rows, key, columns).select(F.substring(F.sha2(F.col("key").cast("string"), 256), 1, depth).alias("leaf"), "key", "digest")
        keyed.repartitionByRange("leaf").sortWithinPartitions("leaf").write.parquet(f"{self.folder}/rows")
        kept = self.spark.read.parquet(f"{self.folder}/rows")
        level = kept.groupBy(F.col("leaf").alias("path")).agg(*_sums("digest"), F.count("*").alias("n")).select("path", F.sha2(_words(), 256).alias("digest"), "n")
        for at in range(depth, -1, -1):
            level.write.parquet(f"{self.folder}/nodes/level={at}")
            below = self.spark.read.parquet(f"{self.folder}/nodes/level={at}")
            children = F.array_sort(F.collect_list(F.struct("path", "digest")))
            text = F.array_join(F.transform(children, lambda c: F.concat(F.substring(c["path"], -1, 1), c["digest"])), "")
            level = below.groupBy(F.substring("path", 1, max(at - 1, 0)).alias("path")).agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("n"))
        return self

    def level(self, at: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/nodes/level={at}").select("path", "digest")

    def depth(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/shape").first().depth

    def root(self) -> str | None:
        """The digest of all rows; None without any."""
        found = self.level(0).first()
        return found.digest if found else None

    def diff(self, other: DigestTree) -> DataFrame:
        """(key, status): keys only here ("gone"), only in ``other`` ("new"), or with different rows ("changed")."""
        leaves = self.unequal(other)[-1]
        named = [r.path for r in leaves.limit(NAMED_LEAVES + 1).collect()]
        few = len(named) <= NAMED_LEAVES

        def rows(tree: DigestTree) -> DataFrame:
            kept = self.spark.read.parquet(f"{tree.folder}/rows")
            return (kept.where(F.col("leaf").isin(named)) if few else kept.join(leaves.select(F.col("path").alias("leaf")), "leaf", "left_semi")).select("key", "digest")

        both = rows(self).withColumnRenamed("digest", "old").join(rows(other).withColumnRenamed("digest", "new"), "key", "full")
        status = F.when(F.col("new").isNull(), "gone").when(F.col("old").isNull(), "new").otherwise("changed")
        return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("key", status.alias("status"))

    def unequal(self, other: DigestTree) -> list[DataFrame]:
        """(path) of the unequal nodes of each level, from the root on; children of equal nodes are not compared."""
        depth = self.depth()
        if depth != other.depth():
            raise ValueError("trees of different depth have no common nodes")
        found = []
        for at in range(depth + 1):
            sides = [self.level(at), other.level(at)]
            if at:
                above = found[-1].select(F.col("path").alias("_above"))
                sides = [s.join(above, F.substring("path", 1, at - 1) == F.col("_above"), "left_semi") for s in sides]
            old, new = sides[0].withColumnRenamed("digest", "old"), sides[1].withColumnRenamed("digest", "new")
            found.append(settled(old.join(new, "path", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("path")))
        return found
