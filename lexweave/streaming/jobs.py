"""Structured Streaming jobs; each runs on what is available and ends.

State is bounded by watermarks, offsets are kept in a checkpoint folder, so a
job that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.session import shared_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    found = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
    # Watermarks need instants; a time without zone is read in the session's zone.
    return found.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in found.dtypes])


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Everything the stream gives now, as a table; with the checkpoint and the folder of an earlier run it goes on there."""
    spark = stream.sparkSession
    out, checkpoint = out or shared_folder(spark), checkpoint or shared_folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def last(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/last")

    stream.writeStream.outputMode(mode).foreachBatch(last).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/last")


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): tumbling windows over event time; later rows than the watermark are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no longer pause than ``gap``."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def after(events: DataFrame, sequence: int, key: str = "event_id") -> DataFrame:
    """The tail of a log behind a cursor."""
    return events.where(F.col(key) > sequence)


def replace_by_key(target: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of a key replace the key's old rows; the last of a batch counts.

    Every batch writes its own folder, so one that runs again writes the same;
    ``current`` reads the newest batch of each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
        newest.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest row of each key; ``compacted`` keeps what has to be ranked small."""
    rows = spark.read.parquet(target).drop("batch")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_batch")))).where("_r = 1").drop("_r", "_batch")


def compacted(spark: SparkSession, target: str, key: str, new_target: str, gone: DataFrame | None = None) -> DataFrame:
    """The upserts of ``target`` as one batch in a new folder: old versions of a key go, as do keys in ``gone``.

    The new batch has the number of the newest old one, so that a stream can go on into it.
    """
    rows = current(spark, target, key)
    last = spark.read.parquet(target).agg(F.max("_batch")).first()[0] or 0
    kept = rows if gone is None else rows.join(gone.select(key).distinct(), key, "left_anti")
    kept.withColumn("_batch", F.lit(last).cast("long")).write.mode("overwrite").parquet(f"{new_target}/batch={last}")
    return current(spark, new_target, key)


def incremental(stream: DataFrame, key: str, order: str) -> DataFrame:
    """An index kept by key from a stream of upserts."""
    spark = stream.sparkSession
    target = shared_folder(spark)
    stream.writeStream.foreachBatch(replace_by_key(target, key, order)).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return current(spark, target, key)


def expand_stream(parts: DataFrame, documents: list[tuple[str, str, str]]) -> DataFrame:
    """(session, position, text): citation handles expanded over parts of a text that come one by one.

    ``documents`` (kind, id, label) are those that the turn offered, in order.
    What a session holds back is its state; a session's part with a null text closes it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from lexweave.functions.citations import Handles, StreamExpander

    def step(key: tuple, batches, state: GroupState):
        handles = Handles()
        for document in documents:
            handles.mint(*document)
        expander = StreamExpander(handles, state.get[0] if state.exists else "")
        rows = pd.concat(list(batches)).sort_values("position")
        out = []
        for position, text in zip(rows["position"], rows["text"], strict=True):
            out.append((key[0], int(position), expander.close() if text is None else expander.feed(text)))
        state.update((expander.held,))
        yield pd.DataFrame(out, columns=["session", "position", "text"])

    return parts.groupBy("session").applyInPandasWithState(step, "session long, position long, text string", "held string", "append", GroupStateTimeout.NoTimeout)
