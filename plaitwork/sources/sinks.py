"""Writers and actions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from plaitwork.operators.bags import own_folder

# Names of storage levels.
LEVELS = {
    "MEMORY_ONLY": StorageLevel.MEMORY_ONLY,
    "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK,
    "MEMORY_AND_DISK_SER": StorageLevel.MEMORY_AND_DISK,
    "DISK_ONLY": StorageLevel.DISK_ONLY,
}


def text(df: DataFrame, path: str, sep: str = ",") -> None:
    """One line per row; fails if the folder exists."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("errorifexists").text(path)


def binary_records(df: DataFrame, path: str) -> int:
    """Fixed-width records, key and value side by side, one file per partition; the number of records.

    Fails if the folder exists.  A task writes under a name of its own and renames the file when it is whole, so a
    task that runs twice leaves one file.  path is a local (shared) path or a URI that pyarrow's file systems open."""
    path = re.sub(r"^file:/+", "/", path)
    system, folder = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
    if system.get_file_info(folder).type != FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(folder)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
        task, n = TaskContext.get(), 0
        name = f"{place}/part-{task.partitionId():05d}"
        with own.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            for batch in it:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out.write(key + value)
                    n += 1
        own.move(f"{name}.{task.taskAttemptId()}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.select("key", "value").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _clocked(df: DataFrame, mode: str, every: str | None, label: str) -> DataStreamWriter:
    """A writer that keeps its progress in the shared folder and runs over what there is, or on a clock (every = "1 second")."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", own_folder(df.sparkSession, label))
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def console(df: DataFrame, mode: str = "append", every: str | None = None) -> StreamingQuery:
    return _clocked(df, mode, every, "console").format("console").start()


def memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """A table in the driver's memory, for looking at small results."""
    return _clocked(df, mode, None, "memory").format("memory").queryName(name).start()


def each_batch(df: DataFrame, act: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None) -> StreamingQuery:
    return _clocked(df, mode, every, "each-batch").foreachBatch(act).start()


def table(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is into Parquet files of the shared folder, and return them: the last batch's rows
    (complete), or those of all batches."""
    spark, folder, done = df.sparkSession, own_folder(df.sparkSession, "stream"), []
    if mode == "append":
        _clocked(df, mode, None, "stream-state").format("parquet").start(folder).awaitTermination()
        return spark.read.schema(df.schema).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")  # a batch that runs again replaces its rows
        if number not in done:
            done.append(number)

    each_batch(df, keep, mode).awaitTermination()
    paths = [f"{folder}/{n}" for n in (done[-1:] if mode == "complete" else done)]
    return spark.read.schema(df.schema).parquet(*paths) if paths else spark.createDataFrame([], df.schema)


def view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def persist(df: DataFrame, level: str = "MEMORY_AND_DISK") -> DataFrame:
    return df.persist(LEVELS[level])


def total(df: DataFrame, column: str) -> float | None:
    return df.agg(F.sum(column)).first()[0]


def mean(df: DataFrame, column: str) -> float | None:
    return df.agg(F.avg(column)).first()[0]


def for_all(df: DataFrame, condition: Column) -> bool:
    return df.where(~F.coalesce(condition, F.lit(False))).isEmpty()
