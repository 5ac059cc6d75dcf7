"""The append-only decision log as a stream: an extension, as the reference has no streaming.

Each micro-batch is appended to a table of decisions; leaves are derived from
the whole table when asked for, so a batch that runs twice changes nothing
that ``current`` gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import review
from cairn.sources.catalog import schema


def follow(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Start appending new decision files of ``source`` to ``target``; one row of each decision_id in a batch."""

    def append(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["decision_id"]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    stream = spark.readStream.schema(schema("review_decisions")).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The leaves of all decisions so far; a decision that came twice counts once."""
    rows = spark.read.schema(schema("review_decisions")).parquet(f"{target}/*").dropDuplicates(["decision_id"])
    return review.current_leaves(rows)
