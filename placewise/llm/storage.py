"""What the operators share: scratch tables, code for the executors, and names that clash with no column."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from placewise.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to the folder in spark.checkpoint.dir and read again; deleted when the session ends.

    The files survive lost executors, cut the lineage and let several consumers read what one pass made.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    removed_at_end(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def removed_at_end(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.deleteOnExit(folder)


def discarded(table: DataFrame) -> None:
    """Deletes the files of a `stored` table that no later plan reads."""
    files, folder = _folder(table.sparkSession, table._stored_at)
    files.delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors as a zip, once per context, as `--py-files` would.

    Task functions are then imported there, and what a worker process remembers lasts from task to task.
    """
    context = spark.sparkContext
    if getattr(context, "_placewise_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(context._temp_dir, "placewise.zip")
    if os.path.isdir(package):
        with zipfile.ZipFile(target, "w") as out:
            for folder, _, names in sorted(os.walk(package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(target)
    context._placewise_shipped = True


def in_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`df.mapInArrow` with this package at hand in every task; a reused worker gives unused memory back after each."""
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
