"""Batches of calls to a provider that stop together and go on where they were.

Calls cost, so what has been answered is stored wave by wave and never asked again;
when one call is refused for a limit, all tasks stop before their next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import settled, shared_folder
from lexweave.sources.snapshots import SnapshotTable


class StopMark:
    """A file in the shared folder that any task may put there and all look for; a retried task finds it too."""

    def __init__(self, spark: SparkSession):
        folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "stop"))
        self.uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()

    def _place(self):
        from pyarrow import fs

        if self.uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.uri)

    def set(self) -> None:
        files, path = self._place()
        files.create_dir(path, recursive=True)

    def is_set(self) -> bool:
        files, path = self._place()
        return files.get_file_info(path).type.name != "NotFound"


def resumed(rows: DataFrame, key: str, call: Callable[[dict], str], store: SnapshotTable, waves: int = 8, tasks: int | None = None) -> DataFrame:
    """Calls for the rows of which ``store`` has no answer yet, in the order of ``key``; (key, output, error) of this run.

    ``store`` is keyed by ``key`` and takes (key, output) after each wave, so that a
    run that ends anywhere loses one wave's answers at most. Rows that failed
    are asked again by the next run. After a refusal for a limit no wave
    is begun: rows not reached have the error "stopped". Rows without
    a key are left out; of rows with one key one is asked. ``tasks`` calls are
    made at a time at most, by default as many as the cluster has cores.
    """
    from lexweave.operators.chat import batch_calls

    spark = rows.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    asked = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    if store.log.versions():
        asked = asked.join(store.read().select(key), key, "left_anti").select(*asked.columns)
    # Ranges of keys are waves; they are dealt once, as a sample of another moment would cut them elsewhere.
    dealt = settled(asked.repartitionByRange(waves, key).withColumn("_wave", F.spark_partition_id()))
    stop, told = StopMark(spark), []
    for wave in range(waves):
        part = dealt.where(F.col("_wave") == wave).drop("_wave")
        if stop.is_set():
            told.append(part.select(key, F.lit(None).cast("string").alias("output"), F.lit("stopped").alias("error")))
            continue
        answered = settled(batch_calls(part.repartition(tasks), call, stop=stop).select(key, "output", "error"))
        told.append(answered)
        fresh = answered.where("output IS NOT NULL").select(key, "output")
        if fresh.take(1):
            store.replace(fresh)
    return reduce(DataFrame.unionByName, told)
