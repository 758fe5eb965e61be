"""Files that tasks write to, and read from, the folder all executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ionloom.session import qualified, scratch_path


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, as a URI that executors can open."""
    return qualified(spark, scratch_path(spark, label))


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """A name no other task attempt uses; only names in a written manifest are ever read."""
    system, path = locate(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    The commit of that table decides which task attempts count, so a repeated or
    speculative task leaves files that nothing refers to.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(files: DataFrame, column: str | list[str], n: int, each: int = 8) -> DataFrame:
    """``n`` rows that name work for a whole task (a file, a shard), one to a task or a few.

    Their bytes say nothing about that work, so the number of partitions is given: adaptive
    execution would join the few small rows into one task. It grows with the files, beyond
    the session's partitions by one for every ``each`` of them. By a list of columns rows
    are dealt in their order.
    """
    usual = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(n, max(usual, -(-n // each))))
    if isinstance(column, str):
        # by a hash of its own: after a join by the same column, dealing by it again would be left out
        return files.repartition(tasks, F.xxhash64(column))
    return files.repartitionByRange(tasks, *column).sortWithinPartitions(*column)
