"""What the training-data operators share: folders, lineage cuts, Arrow maps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexweave.session import settled

#: Rows and bytes that go to a Python worker at once, so that long texts stay bounded; a batch ends at the row that exceeds the bytes.
ARROW_ROWS, ARROW_BYTES = 1024, "4m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, size: str = ARROW_BYTES) -> None:
    """Lower the size of Arrow batches for maps over long texts, for this session: plans are lazy, so it holds beyond the call."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder, read back; ``session.discard`` deletes it.

    Cuts the lineage: a lost executor costs only the reading of files.
    """
    return settled(frame, name)


def free(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as it takes to differ from all others, case aside."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def append_columns(
    frame: DataFrame,
    fields: Sequence[T.StructField],
    compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """``frame`` with columns computed from Arrow batches; other columns pass through.

    ``compute`` is called once for each task and returns the function of a
    batch, so that models and tables load once. A new name that is in use gets
    underscores until it is free.
    """
    taken = list(frame.columns)
    for i, field in enumerate(fields):
        name = free(field.name, taken)
        fields = [*fields[:i], T.StructField(name, field.dataType, field.nullable), *fields[i + 1 :]]
        taken.append(name)
    schema = T.StructType([*frame.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        names = [f.name for f in fields]
        for batch in batches:
            new = function(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return frame.mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that this worker has freed to the system, so that what one block took is not held beside the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
