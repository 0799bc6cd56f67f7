"""Batches of calls: one refusal stops all tasks, and the next run goes on from what is stored."""

import time

from lexweave.operators.batches import resumed
from lexweave.sources.snapshots import SnapshotTable


def caller(log, refuse=(), fail=()):
    def call(row):
        with open(log, "a") as out:
            out.write(f"{row['id']}\n")
        time.sleep(0.03)
        if row["id"] in refuse:
            raise RuntimeError("429 Too Many Requests")
        if row["id"] in fail:
            raise ValueError("no answer")
        return row["text"].upper()

    return call


def test_a_refusal_stops_all_tasks_and_the_next_run_goes_on(spark, tmp_path):
    log, store = f"{tmp_path}/calls", SnapshotTable(spark, f"file://{tmp_path}/store", "id")
    rows = spark.createDataFrame([(n, f"t{n}") for n in range(120)] + [(None, "x"), (3, "t3")], "id long, text string")
    tasks, wave = 4, 30
    first = {r.id: (r.output, r.error) for r in resumed(rows, "id", caller(log, refuse={45}, fail={2}), store, 4, tasks).collect()}
    calls = [int(x) for x in open(log)]
    assert sorted(first) == list(range(120)) and len(calls) == len(set(calls))
    # No more than one call of each task is under way when the refusal comes.
    assert len(calls) - 1 - calls.index(45) <= tasks
    assert first[45] == (None, "429 Too Many Requests") and first[2] == (None, "no answer")
    stopped = {n for n, (_, error) in first.items() if error == "stopped"}
    assert stopped == set(range(120)) - set(calls) and len(stopped) > 120 - 2 * wave - tasks
    assert {r.id for r in store.read().collect()} == set(calls) - {45, 2}
    second = {r.id: r.output for r in resumed(rows, "id", caller(log), store, 4, tasks).collect()}
    assert set(second) == stopped | {45, 2} and [int(x) for x in open(log)][len(calls) :].__len__() == len(second)
    assert {r.id: r.output for r in store.read().collect()} == {n: f"T{n}" for n in range(120)}
    assert resumed(rows, "id", caller(log, refuse=set(range(120))), store, 4, tasks).collect() == []


def test_no_rows(spark, tmp_path):
    store = SnapshotTable(spark, f"file://{tmp_path}/store", "id")
    assert resumed(spark.createDataFrame([], "id long, text string"), "id", caller(f"{tmp_path}/calls"), store).collect() == []
    assert store.log.versions() == []
