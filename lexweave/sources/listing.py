"""A source of listing pages, read as a batch or as a stream, and the incremental crawl over it.

A listing shows its newest rows first: days do not rise from one page to the
next. A crawl therefore ends at the first page whose oldest day has reached the
mark; pages behind that one are never fetched. "Reached" means older than the mark's day, as rows of that day
may go on over the next page.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from lexweave.session import settled
from lexweave.sources.snapshots import SnapshotTable

DAY = "day"


class _Page(InputPartition):
    def __init__(self, number: int, since: str | None = None, until: str | None = None, on: bool = False):
        self.number, self.since, self.until, self.on = number, since, until, on


class _Listing:
    """Pages by number; ``at`` is the place of the day among a row's fields."""

    def __init__(self, options: dict, fetch: Callable[[int], list[tuple]], at: int):
        self.pages, self.fetch, self.at = int(options.get("pages", 1)), fetch, at

    def day(self, row: tuple) -> str | None:
        return row[self.at].date().isoformat() if row[self.at] is not None else None

    def days(self, rows: list[tuple]) -> list[str]:
        return sorted(d for d in map(self.day, rows) if d is not None)

    def ends(self, rows: list[tuple], since: str | None) -> bool:
        """Whether a page's oldest day is before the mark's; a page without days never ends a crawl."""
        days = self.days(rows)
        return since is not None and bool(days) and days[0] < since

    def needed(self, since: str | None) -> int:
        """How many pages reach the mark: all without one, else those up to the first that ends there."""
        if since is None:
            return self.pages
        return next((n + 1 for n in range(self.pages) if self.ends(self.fetch(n), since)), self.pages)

    def rows(self, page: _Page) -> Iterator[tuple]:
        """A page's rows from the mark's day on; the last page goes on while rows have moved behind it since it was counted."""
        for number in count(page.number):
            rows = self.fetch(number)
            for row in rows:
                day = self.day(row)
                if day is None or ((page.since is None or day >= page.since) and (page.until is None or day <= page.until)):
                    yield row
            if not page.on or not rows or self.ends(rows, page.since) or number + 1 >= self.pages:
                return


class _Reader(DataSourceReader):
    """Each needed page is a task."""

    def __init__(self, listing: _Listing):
        self.listing, self.since = listing, None

    def partitions(self) -> list[_Page]:
        return [_Page(n, self.since) for n in range(self.listing.needed(self.since))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from self.listing.rows(partition)


class _BoundedReader(_Reader):
    """A lower bound of the day, pushed down, bounds the pages."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == (DAY,):
                bound = f.value.date().isoformat()
                self.since = max(self.since or bound, bound)
            # Days bound pages; Spark still compares the instants of each row.
            yield f


class _StreamReader(DataSourceStreamReader):
    """An offset is the newest day listed and a digest of the first page.

    A batch reads from the day of its start to that of its end, so that one that
    is run again asks for the same days though the listing has moved meanwhile.
    Rows of the start's day come again, as more may have been listed on that day
    since; rows without a day come with every page. What takes the stream
    replaces by key.
    """

    def __init__(self, listing: _Listing):
        self.listing = listing

    def initialOffset(self) -> dict:
        return {"day": None, "first": ""}

    def latestOffset(self) -> dict:
        rows = self.listing.fetch(0)
        if not rows:
            return self.initialOffset()
        days = self.listing.days(rows)
        return {"day": days[-1] if days else None, "first": hashlib.sha256(repr(rows).encode()).hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        if end["first"] in ("", start["first"]):
            return []
        n = self.listing.needed(start["day"])
        return [_Page(k, start["day"], end["day"], k + 1 == n) for k in range(n)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from self.listing.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def listing_source(fetch: Callable[[int], list[tuple]], kind: str = "listing", fields: str = "id string, url string, title string, day timestamp") -> type[DataSource]:
    """A data source that reads each page of a listing in a task of its own; ``fetch`` gives a page's rows, none behind the last.

    The option ``pages`` bounds the pages. With the option ``bounded`` a filter ``day > x`` is
    pushed down; the session must have ``spark.sql.python.filterPushdown.enabled`` then. The driver looks
    at pages one by one only to find where to stop, so the fetch is best cached.
    """
    at = [f.split()[0] for f in fields.split(",")].index(DAY)

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            bounded = str(self.options.get("bounded", "false")).lower() == "true"
            return (_BoundedReader if bounded else _Reader)(_Listing(self.options, fetch, at))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(_Listing(self.options, fetch, at))

    return Listing


def crawl(spark: SparkSession, kind: str, pages: int, store: SnapshotTable, checkpoint: str) -> None:
    """Takes what a listing shows beyond the last crawl into ``store``, keyed by ``id``; ids that are stored stay as they are.

    The checkpoint holds the mark: the next crawl goes on there. A batch that was
    stored but not marked finds its ids stored when it is run again.
    """

    def take(batch: DataFrame, number: int) -> None:
        fresh = batch.where("id is not null").dropDuplicates(["id"]).withColumn("crawl", F.lit(number).cast("long"))
        if store.log.versions():
            fresh = fresh.join(store.read().select("id"), "id", "left_anti").select(*fresh.columns)
        # Written once, as a listing that moves would give the rows and their keys differently.
        fresh = settled(fresh)
        if fresh.take(1):
            store.replace(fresh)

    listed = spark.readStream.format(kind).option("pages", pages).load()
    listed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_rows(listed: DataFrame, stored: DataFrame, stop_at: datetime | None = None) -> DataFrame:
    """Listed rows not stored yet and newer than the mark, each address once, the newest first."""
    found = listed.dropDuplicates(["url"]).join(stored.select("id"), "id", "left_anti")
    return (found.where(F.col("day") > F.lit(stop_at)) if stop_at else found).orderBy(F.desc("day"), "id")


def availability(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many listed rows are missing, the newest of them, and a status."""
    missing = listed.join(stored.select("id"), "id", "left_anti")
    return missing.agg(F.count("*").alias("missing"), F.max_by("id", "day").alias("newest")).withColumn("status", F.when(F.col("missing") > 0, "new_available").otherwise("fresh"))


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: a new row's values count where they are there, else the old ones; other rows stay."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose columns differ; null equals null."""
    joined = new.alias("n").join(old.alias("o"), key)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return joined.where(differs).select(key)
