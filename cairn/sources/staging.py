"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


#: Rows that one task sorts or groups; compressed sizes, by which Spark merges partitions, say little of narrow rows.
TASK_ROWS = 250_000


def parts(df: DataFrame) -> int:
    """Into how many parts the rows of a table are to be dealt."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The table dealt by some columns to as many parts as so many rows need, which Spark then doesn't merge."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *by)


def shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one if driver and tasks share a disk, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors see")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="cairn-stage-"))
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/cairn-{os.getpid()}"


def once(owner, name: str, make) -> DataFrame:
    """The table that ``make`` gives, written for its owner the first time, as several of its steps start from it."""
    held = owner.__dict__.setdefault("_once", {})
    if name not in held:
        held[name] = written(make(), name)
    return held[name]


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
