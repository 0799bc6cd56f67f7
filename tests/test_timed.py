"""Operators with timers: versions come into force and traces close without new rows of theirs."""

from datetime import datetime, timedelta

import pytest

from lexweave.streaming import jobs, timed

START = datetime(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)


@pytest.fixture
def rocks(spark):
    with timed.timed(spark):
        yield spark


def batches(spark, folder, fields, parts):
    """A stream that takes one written file after the other."""
    schema = spark.createDataFrame([], fields).schema
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{folder}/{n}")
        yield spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))


def flips(rows):
    return sorted((r.document_id, r.version_id, r.effective_from, r.replaced) for r in rows.collect())


VERSIONS = "document_id long, version_id long, effective_from timestamp, ts timestamp"


def test_a_version_comes_into_force_without_a_row_of_its_document(rocks, tmp_path):
    parts = [
        [(1, 10, day(-5), day(0)), (1, 11, day(3), day(0)), (1, 12, day(8), day(0)), (None, 1, day(0), day(0)), (2, None, day(0), day(0)), (3, 1, None, day(0))],
        [(9, 90, day(1), day(5))],
        [(9, 91, day(-9), day(6)), (1, 11, day(3), day(6)), (1, 9, day(3), day(6)), (1, 13, day(2), day(6))],
        [(9, 92, day(50), day(20))],
    ]
    # The first batch has no watermark yet, so the version of five days ago waits for the batch without rows behind it.
    expected = [
        [(1, 10, day(-5), None)],
        [(1, 10, day(-5), None), (1, 11, day(3), 10), (9, 90, day(1), None)],
        [(1, 9, day(3), 11), (1, 10, day(-5), None), (1, 11, day(3), 10), (9, 90, day(1), None)],
        [(1, 9, day(3), 11), (1, 10, day(-5), None), (1, 11, day(3), 10), (1, 12, day(8), 9), (9, 90, day(1), None)],
    ]
    checkpoint = f"file://{tmp_path}/checkpoint"
    for stream, want in zip(batches(rocks, tmp_path / "in", VERSIONS, parts), expected, strict=True):
        assert flips(jobs.drain(timed.currency_flips(stream), checkpoint=checkpoint, out=f"file://{tmp_path}/out")) == want


def test_a_replay_gives_equal_rows(rocks, tmp_path):
    rows = [(d, 100 * d + k, day((7 * d + 13 * k) % 40), day(k)) for d in range(6) for k in range(20)]
    *_, stream = batches(rocks, tmp_path / "in", VERSIONS, [rows[:70], rows[70:]])
    first = flips(jobs.drain(timed.currency_flips(stream)))
    assert first == flips(jobs.drain(timed.currency_flips(stream))) and len(first) > 12
    last = {d: max((e, -v) for x, v, e, _ in first if x == d) for d in range(6)}
    mark = day(19)
    for d in range(6):
        assert last[d] == max((e, -v) for x, v, e, _ in rows if x == d and e <= mark)


def test_an_unfinished_trace_closes_itself(rocks, tmp_path):
    fields = "trace_id long, ends boolean, ts timestamp"
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [(1, False, at(0)), (1, True, at(5)), (1, True, at(7)), (2, False, at(1)), (3, None, at(2)), (None, True, at(2))],
        [(2, False, at(50)), (4, False, at(90))],
        [(4, False, at(100)), (5, False, at(300)), (2, True, at(200))],
    ]
    checkpoint = f"file://{tmp_path}/checkpoint"
    expected = [
        [(1, "finished", at(5))],
        [(1, "finished", at(5)), (3, "interrupted", at(62))],
        [(1, "finished", at(5)), (2, "finished", at(200)), (3, "interrupted", at(62)), (4, "interrupted", at(160))],
    ]
    for stream, want in zip(batches(rocks, tmp_path / "in", fields, parts), expected, strict=True):
        found = jobs.drain(timed.trace_ends(stream, 60), checkpoint=checkpoint, out=f"file://{tmp_path}/out")
        assert sorted((r.trace_id, r.state, r.at) for r in found.collect()) == want
