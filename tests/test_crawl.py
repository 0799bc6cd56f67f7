"""The listing source: early stop, pushed bounds, restart from its offset."""

from datetime import datetime, timedelta

import pytest

from lexweave.sources import listing
from lexweave.sources.snapshots import SnapshotTable

START = datetime(2024, 1, 1)


def source(folder, name, rows, size=3):
    """A listing of ``rows`` (id, day), newest first, that notes each page it is asked for."""
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    log = str(folder / f"{name}.log")

    def fetch(n):
        with open(log, "a") as out:
            out.write(f"{n}\n")
        part = ordered[n * size : (n + 1) * size]
        return [(f"id{k}", f"u{k}", "t", None if d is None else START + timedelta(days=d)) for k, d in part]

    return listing.listing_source(fetch, name), lambda: sorted({int(x) for x in open(log).read().split()})


def stored(store):
    return {r.id: r.crawl for r in store.read().collect()}


def test_a_crawl_goes_on_at_its_mark_and_fetches_nothing_behind_it(spark, tmp_path):
    store, mark = SnapshotTable(spark, f"file://{tmp_path}/store", "id"), f"{tmp_path}/checkpoint"
    rows = [(k, k) for k in range(30)]
    for n, more in enumerate([[], [(30, 29), (31, 30), (32, 31)], [(k, k) for k in range(33, 41)]]):
        rows = rows + more
        made, asked = source(tmp_path, f"pages_{n}", rows)
        made.name = classmethod(lambda cls: "crawled")
        spark.dataSource.register(made)
        listing.crawl(spark, "crawled", 100, store, mark)
        assert stored(store) == {f"id{k}": 0 if k < 30 else 1 if k < 33 else 2 for k, _ in rows}
        if n == 1:
            # Three new rows, one of them of the mark's day and on the second page of eleven.
            assert asked() == [0, 1]
        if n == 2:
            assert asked() == [0, 1, 2, 3]
    # Nothing new: only the first page is looked at, and no commit is made.
    before = len(store.log.versions())
    made, asked = source(tmp_path, "pages_same", rows)
    made.name = classmethod(lambda cls: "crawled")
    spark.dataSource.register(made)
    listing.crawl(spark, "crawled", 100, store, mark)
    assert asked() == [0] and len(store.log.versions()) == before


def test_a_batch_bound_reaches_the_pages(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        made, asked = source(tmp_path, "bounded", [(k, k) for k in range(30)])
        spark.dataSource.register(made)
        found = spark.read.format("bounded").options(pages=10, bounded=True).load().where(f"day > timestamp '{START + timedelta(days=24)}'")
        assert sorted(r.id for r in found.collect()) == [f"id{k}" for k in range(25, 30)]
        assert asked() == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_rows_that_move_while_pages_are_read_are_not_lost(tmp_path):
    """Between the counting of pages and their reading two rows are listed on top."""
    days = {"rows": [(k, k) for k in range(12, 0, -1)]}
    fetch = lambda n: [(f"id{k}", "u", "t", START + timedelta(days=d)) for k, d in days["rows"][n * 3 : n * 3 + 3]]
    reader = listing._StreamReader(listing._Listing({"pages": "9"}, fetch, 3))
    start, end = {"day": (START + timedelta(days=7)).date().isoformat(), "first": "x"}, reader.latestOffset()
    parts = reader.partitions(start, end)
    days["rows"] = [(14, 14), (13, 13), *days["rows"]]
    got = {r[0] for p in parts for r in reader.read(p)}
    assert got == {f"id{k}" for k in range(7, 13)}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, None)], [(1, 5), (1, 5), (2, None)]])
def test_empty_listings_missing_days_and_repeated_rows(spark, tmp_path, rows):
    store = SnapshotTable(spark, f"file://{tmp_path}/store", "id")
    made, _ = source(tmp_path, "odd", rows)
    spark.dataSource.register(made)
    for _ in range(2):
        listing.crawl(spark, "odd", 5, store, f"{tmp_path}/checkpoint")
    if rows:
        assert stored(store) == {f"id{k}": 0 for k, _ in rows}
    else:
        assert store.log.versions() == []
