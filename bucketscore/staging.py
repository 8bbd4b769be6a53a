"""Intermediate tables in the cluster's shared folder, and broadcast size checks.

A result that several later jobs read (training rows, bucket tables) is written once as
parquet. That cuts the lineage, survives the loss of executors, keeps column pruning for the
readers, and gives an exact row count for the join decisions.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Staged:
    """A table written to the shared folder, with its row count and other facts seen on the way."""

    df: DataFrame
    rows: int
    path: str
    facts: dict = field(default_factory=dict)
    # False for files that someone else saved; ``drop`` leaves those alone.
    owned: bool = True


#: Narrow rows, such as the edges of a graph, that one task takes at once: some 2 MB.
ROWS_A_TASK = 100_000

# Tables staged since the innermost ``passing`` began.
_made: ContextVar[list[Staged] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the session's warehouse.

    Both are folders that every executor can reach; a temporary folder of one machine is not.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged").rstrip("/")


def session_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    location, files = _file_system(spark, path)
    files.mkdirs(location)
    files.deleteOnExit(location)
    return path


def stage(df: DataFrame, name: str, **facts: Column) -> Staged:
    """Write ``df`` to the shared folder and return it as a table with its row count.

    ``facts`` are further aggregates, measured while the rows are written. The table is for this
    session: it is deleted by ``drop``, or at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark, name)}/rows"
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("rows"), *[fact.alias(key) for key, fact in facts.items()]]
    df.observe(seen, *measures).write.parquet(path)
    found = dict(seen.get)
    table = Staged(spark.read.schema(df.schema).parquet(path), int(found["rows"]), path, found)
    if _made.get() is not None:
        _made.get().append(table)
    return table


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have at most ``rows`` narrow rows, in no more partitions than they need.

    The fixed cost of a task is that of thousands of such rows. Larger tables have more tasks; up to
    ``ROWS_A_TASK`` rows lie in one partition, so that joins and sums over them need no shuffle.
    """
    return df.coalesce(max(1, math.ceil(rows / ROWS_A_TASK)))


def drop(spark: SparkSession, *tables: Staged) -> None:
    """Delete staged tables that no DataFrame needs any more."""
    for table in (t for t in tables if t.owned):
        location, files = _file_system(spark, table.path)
        files.delete(location, True)


def release(spark: SparkSession, *tables: Staged) -> None:
    """``drop``, and the shuffle files of finished jobs with it: Spark deletes those of plans that are garbage."""
    drop(spark, *tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[Staged]]:
    """Tables staged inside go at the end, but for those that the block puts into the list it is given.

    A job in passes holds the disk of one pass at a time.
    """
    outer, made, kept = _made.get(), [], []
    token = _made.set(made)
    try:
        yield kept
    finally:
        _made.reset(token)
        paths = {t.path for t in kept}
        release(spark, *[t for t in made if t.path not in paths])
        if outer is not None:
            outer.extend(kept)


def _file_system(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes a broadcast side may have: the session's own join threshold, 0 when disabled."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    for suffix, factor in units.items():
        if text.endswith(suffix):
            return max(0, int(text[: -len(suffix)]) * factor)
    return max(0, int(text))


def row_bytes(schema: T.StructType, array_length: int = 0) -> int:
    """Upper estimate of one row in memory; arrays count ``array_length`` doubles."""
    width = 32
    for field in schema.fields:
        width += 24 + 8 * array_length if isinstance(field.dataType, T.ArrayType) else 8
    return width
