"""The usage ledger as a stream: log lines in, events kept once, rollups on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.jsonl import usage_events


def harvest(spark: SparkSession, logs: str, table: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Append the log folder's new events to a Parquet ledger, each id once for the life of the checkpoint. The checkpoint replaces
    byte cursors; the file sink commits a batch whole or not at all. The state that remembers ids grows with
    distinct events: for a log of unbounded age bound it with a watermark by `harvest_within`.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(logs)
    return _write(usage_events(lines).dropDuplicates(["id"]), table, checkpoint)


def harvest_within(spark: SparkSession, logs: str, table: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """As harvest, remembering ids for `delay` only; events without a time are left out."""
    events = usage_events(spark.readStream.text(logs)).filter("ts is not null").withWatermark("ts", delay)
    return _write(events.dropDuplicatesWithinWatermark(["id"]), table, checkpoint)


def _write(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (
        events.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rollup(ledger: DataFrame) -> DataFrame:
    """Sums by source session; NULL stays unknown."""
    names = ("prompt_tokens", "cached_tokens", "completion_tokens", "reasoning_tokens")
    return ledger.groupBy("source", "source_session_id").agg(
        *[F.sum(n).alias(n) for n in names], F.count("*").alias("events"), F.max("ts").alias("last")
    )
