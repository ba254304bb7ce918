"""Calls and their results as streams: a result may come long after its call, or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(calls: DataFrame, results: DataFrame, wait: str = "1 day") -> DataFrame:
    """Streams calls (session_id, tool_use_id, name, at) and results (session_id, tool_use_id, summary, at) -> each call with
    its result, once, in whichever order the two come, or without one when `wait` has gone by. The state holds what came
    within the wait. A result that is told twice answers with what came first."""
    made = calls.select(F.col("session_id").alias("_s"), F.col("tool_use_id").alias("_t"), "name", F.col("at").alias("called_at"))
    made = made.withWatermark("called_at", wait)
    answers = results.withWatermark("at", wait).dropDuplicatesWithinWatermark(["session_id", "tool_use_id"])
    near = f"at BETWEEN called_at - INTERVAL {wait} AND called_at + INTERVAL {wait}"
    both = made.join(answers, (F.col("_s") == F.col("session_id")) & (F.col("_t") == F.col("tool_use_id")) & F.expr(near), "left_outer")
    return both.select(F.col("_s").alias("session_id"), F.col("_t").alias("tool_use_id"), "name", "called_at", "summary", "at")
