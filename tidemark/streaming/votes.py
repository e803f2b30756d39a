"""Contributions as a stream: running vote sums, and a feed of tasks that enough analysts have answered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_votes(stream: DataFrame) -> DataFrame:
    """(task, votes, seen) so far; for the update or complete output mode."""
    return stream.groupBy("task").agg(F.sum(F.col("verdict").cast("long")).alias("votes"), F.count("verdict").alias("seen"))


def windowed_rates(stream: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rates by task and window, with state bounded by a watermark; ``ts`` becomes a timestamp with a zone first."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), "task").agg(F.count("verdict").alias("seen"), F.avg(F.col("verdict").cast("double")).alias("rate"))


def distinct_contributions(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """One row for each analyst and task within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["analyst", "task"])
