"""Stateful operators that act when a time arrives, not only when a row does.

Each key, or bucket of traces, has its own state and its own timers, so that nothing is
read again to see what time has changed. Time is the stream's watermark ("EventTime"), by which a
log that is run again gives equal rows, or the clock ("ProcessingTime"). State
is in RocksDB, which the session must name while a stream starts; within ``timed`` it does.

Versions or traces without a key or a time are left out. Rows that come again
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups of traces with a state each; a batch writes those whole that it has rows of.
TRACE_BUCKETS = 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed(spark: SparkSession) -> Iterator[SparkSession]:
    """The session with the state store that timers need; the session's own comes back afterwards."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)
    try:
        yield spark
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def _instant(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class _Clock:
    """What "now" is for a processor, in milliseconds."""

    def __init__(self, mode: str):
        self.mode = mode

    def now(self, values) -> int:
        return values.getCurrentWatermarkInMs() if self.mode == "EventTime" else values.getCurrentProcessingTimeInMs()


class _Currency(StatefulProcessor):
    """Pending versions in a list, the one in force in a value; one timer, to the first pending day.

    Each call to a state goes from Python to the JVM, so a document makes a few calls
    a batch, however many versions it has.
    """

    def __init__(self, mode: str):
        self.clock = _Clock(mode)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "effective long, version long")
        self.next = handle.getValueState("next", "effective long")
        self.current = handle.getValueState("current", "effective long, version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.clock.now(timerValues)
        arrived: tuple[int, int] | None = None
        fresh: dict[int, int] = {}
        for row in rows:
            day, version = row.effective_ms, row.version_id
            if day > now:
                fresh[day] = min(version, fresh.get(day, version))
            elif arrived is None or (day, -version) > (arrived[0], -arrived[1]):
                arrived = (day, version)
        if fresh:
            self.pending.appendList(list(fresh.items()))
            self.wait(min(fresh), self.next.get())
        if arrived is not None:
            yield from self.enter(key, [arrived])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(self.clock.now(timerValues), expiredTimerInfo.getExpiryTimeInMs())
        days: dict[int, int] = {}
        for day, version in self.pending.get():
            days[day] = min(version, days.get(day, version))
        later = {d: v for d, v in days.items() if d > now}
        if later:
            self.pending.put(list(later.items()))
            self.wait(min(later), None)
        else:
            self.pending.clear()
            self.next.clear()
        yield from self.enter(key, sorted((d, v) for d, v in days.items() if d <= now))

    def wait(self, day: int, held: tuple | None) -> None:
        if held is None or day < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(day)
            self.next.update((day,))

    def enter(self, key, versions: list[tuple[int, int]]) -> Iterator[Row]:
        before = held = self.current.get()
        for effective, version in versions:
            if held is None or (effective, -version) > (held[0], -held[1]):
                yield Row(document_id=key[0], version_id=version, effective_from=_instant(effective), replaced=held[1] if held else None)
                held = (effective, version)
        if held is not before:
            self.current.update(held)

    def close(self) -> None:
        pass


def currency_flips(versions: DataFrame, late: str = "0 seconds", mode: str = "EventTime") -> DataFrame:
    """(document_id, version_id, effective_from, replaced) each time a version comes into force.

    ``versions`` is a stream of (document_id, version_id, effective_from, ts), all but the
    last two longs; days of effect are given in UTC. A version of a day to come waits for its timer; one of a past day counts at
    once, unless one with a later day is in force. Of versions with one day
    the smallest id counts.
    """
    told = versions.withWatermark("ts", late).where("document_id is not null and version_id is not null and effective_from is not null")
    rows = told.select("document_id", "version_id", F.unix_millis("effective_from").alias("effective_ms"), "ts")
    fields = "document_id long, version_id long, effective_from timestamp_ntz, replaced long"
    return rows.groupBy("document_id").transformWithState(_Currency(mode), fields, "Append", mode)


class _Traces(StatefulProcessor):
    """The traces of a bucket: the last sign of each, or when it was closed, packed into one value; one timer, to the first that is due.

    Each call to a state goes from Python to the JVM, so a bucket makes a few calls a
    batch, however many traces it has. A timer that a later sign has overtaken
    only sets the next one.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "next long, traces binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = None
        for part in rows:
            part = pd.DataFrame({"trace_id": part["trace_id"], "newest": part["ms"], "first_end": part["ms"].where(part["ends"]).astype("Int64")})
            # A part may bring the same traces again: what is held is a row for each.
            fresh = (part if fresh is None else pd.concat([fresh, part])).groupby("trace_id", as_index=False, sort=False).agg({"newest": "max", "first_end": "min"})
        if fresh is None:
            return
        timer, traces = self.read()
        seen = fresh if traces is None else fresh.merge(traces, "left", "trace_id")
        if traces is not None:
            held = seen["ms"].astype("Int64")
            seen = seen.assign(newest=seen["newest"].where(held.isna(), seen["newest"].clip(lower=held.fillna(0).astype("int64"))))
            seen = seen[~seen["closed"].eq(True)]
        closed = seen["first_end"].notna()
        now = pd.DataFrame({"trace_id": seen["trace_id"], "ms": seen["first_end"].fillna(seen["newest"]).astype("int64"), "closed": closed.astype(bool)})
        if len(now):
            self.write(timer, now if traces is None else pd.concat([traces[~traces["trace_id"].isin(now["trace_id"])], now]))
        if closed.any():
            yield self.told(now[now["closed"]], "finished")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = max(timerValues.getCurrentWatermarkInMs(), at)
        timer, traces = self.read()
        if traces is None or timer != at:
            return
        ended = traces[(traces["ms"] + self.ttl <= now) & ~traces["closed"]]
        ended = ended.assign(ms=ended["ms"] + self.ttl, closed=True)
        traces = pd.concat([traces.drop(ended.index), ended])
        # Where a second time to live has passed since a trace was closed, it is forgotten.
        self.write(None, traces[~traces["closed"] | (traces["ms"] + self.ttl > now)])
        if len(ended):
            yield self.told(ended, "interrupted")

    def read(self) -> tuple[int | None, pd.DataFrame | None]:
        held = self.held.get()
        if held is None:
            return None, None
        return held[0], pa.ipc.open_stream(bytes(held[1])).read_all().to_pandas()

    def write(self, timer: int | None, traces: pd.DataFrame) -> None:
        if not len(traces):
            self.held.clear()
            return
        due = int(traces["ms"].min()) + self.ttl
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        table = pa.Table.from_pandas(traces, preserve_index=False)
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.held.update((timer, sink.getvalue().to_pybytes()))

    def told(self, traces: pd.DataFrame, state: str) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": traces["trace_id"], "state": state, "at": pd.to_datetime(traces["ms"], unit="ms")}).reset_index(drop=True)

    def close(self) -> None:
        pass


def trace_ends(events: DataFrame, ttl_seconds: int, late: str = "0 seconds", buckets: int = TRACE_BUCKETS) -> DataFrame:
    """(trace_id, state, at in UTC): each trace's end, told by an event or, without any sign for ``ttl_seconds``, by a timer.

    ``events`` is a stream of (trace_id, ends, ts). A closed trace takes no more
    events; it is forgotten after a further ``ttl_seconds``, so that state doesn't grow.
    Traces are dealt to ``buckets`` with a state each, of which a task holds one at a time;
    a checkpoint goes on with the number that it began with.
    """
    rows = events.withWatermark("ts", late).where("trace_id is not null and ts is not null").select("trace_id", F.coalesce("ends", F.lit(False)).alias("ends"), F.unix_millis("ts").alias("ms"), "ts")
    kind = dict(rows.dtypes)["trace_id"]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Traces(ttl_seconds * 1000), f"trace_id {kind}, state string, at timestamp_ntz", "Append", "EventTime")
