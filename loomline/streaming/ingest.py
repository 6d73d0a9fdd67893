"""Incremental ingest: new files go through a checkpointed stream into a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.sinks import keep_latest


def ingest_available(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, file_format: str = "parquet") -> None:
    """Append what is new under ``source`` since the last run, then stop.

    Each batch is written under its id, so a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).format(file_format).load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_rows(spark: SparkSession, target: str, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The table that the batches make up: the latest row of each key."""
    return keep_latest(spark.read.parquet(target), keys, [*newest, "batch"]).drop("batch")


def pending_months(wanted: DataFrame, done: DataFrame, month: str = "month_key") -> DataFrame:
    """Months that a sweep has still to do."""
    return wanted.select(month).distinct().join(done.select(month).distinct(), month, "left_anti")
