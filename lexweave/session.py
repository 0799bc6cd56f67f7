"""Session factory with the settings the operators expect."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lexweave", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for local work; on a cluster the submitter's own settings win.

    Shuffle partitions are sized to the cores here; on a cluster they are sized
    so that one partition fits an executor's share of memory, and adaptive
    execution coalesces or splits from there.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LEXWEAVE_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.appName(name).master(f"local[{cpus}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables below ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing (tests, one machine) a temporary folder of this
    process stands in, which goes when the process ends; no cluster runs without
    the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "folder" not in _OWN:
            folder = tempfile.mkdtemp(prefix="lexweave-")
            atexit.register(shutil.rmtree, folder, True)
            _OWN["folder"] = f"file://{folder}"
        found = _OWN["folder"]
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str = "lexweave") -> str:
    """A new folder below the shared one; ``discard`` deletes it."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def settled(frame: DataFrame, name: str = "lexweave") -> DataFrame:
    """``frame`` as a written Parquet table in the shared folder, read back.

    Its lineage ends there: a lost executor costs only the reading of files.
    """
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that this process has written so far; frames that read them are void. Gives their number.

    Results must be written elsewhere or collected before, as they are lazy.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
