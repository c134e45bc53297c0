"""Timing log lines: reading, writing and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TIMING_EVENT

PREFIX = "[PERF] "  # fixed value: start of a timing line


def parse_timings(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per timing line: ``(event, label, total_seconds, stages, context)``."""
    payload = F.from_json(F.substr(F.col(column), F.lit(len(PREFIX) + 1)), TIMING_EVENT)
    return (
        lines.filter(F.startswith(column, F.lit(PREFIX)))
        .select(payload.alias("t"))
        .filter(F.col("t.event") == "perf_timing")
        .select("t.*")
    )


def format_timings(events: DataFrame) -> DataFrame:
    """The reverse: ``(label, total_seconds, stages, context)`` to log lines."""
    stages = F.transform(
        "stages", lambda s: F.struct(s["name"].alias("name"), F.round(s["seconds"], 6).alias("seconds"))
    )
    payload = F.struct(
        "context", F.lit("perf_timing").alias("event"), "label", stages.alias("stages"),
        F.round("total_seconds", 6).alias("total_seconds"),
    )
    return events.select(F.concat(F.lit(PREFIX), F.to_json(payload)).alias("value"))


def run_statistics(timings: DataFrame) -> DataFrame:
    """Runs, mean, minimum and maximum of the total seconds per label."""
    return timings.groupBy("label").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("total_seconds"), 6).alias("mean_seconds"),
        F.round(F.min("total_seconds"), 6).alias("min_seconds"),
        F.round(F.max("total_seconds"), 6).alias("max_seconds"),
    )


def stage_totals(timings: DataFrame) -> DataFrame:
    """Summed seconds per label and stage."""
    stages = timings.select("label", F.explode("stages").alias("s"))
    return stages.groupBy("label", F.col("s.name").alias("stage")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("s.seconds"), 6).alias("seconds")
    )
