"""Which retained artifacts to delete, by age and by total size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .jobs import artifact_flags, error_jobs, reference_time
from .ordered import scan, with_row_number


def retained_bytes(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("retained_bytes"))


def error_jobs_with_artifacts(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(job_id, id, since, size_bytes)`` of failed jobs that still have something on disk."""
    failed = error_jobs(jobs)
    sizes = artifacts.groupBy("job_id").agg(F.sum("size_bytes").alias("size_bytes"))
    return (
        failed.join(artifact_flags(failed, artifacts), ["job_id"], "left_semi")
        .join(sizes, ["job_id"], "left")
        .select("job_id", "id", reference_time().alias("since"),
                F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))
    )


def oldest_with_artifacts(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The failed job that the size limit would delete first."""
    waiting = error_jobs_with_artifacts(jobs, artifacts)
    first = F.min_by(F.struct("job_id", "since", "size_bytes"), F.struct("since", "id"))
    return waiting.agg(first.alias("j")).filter(F.col("j").isNotNull()).select("j.*")


def expired_jobs(jobs: DataFrame, artifacts: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    """Failed jobs with artifacts older than ``days``; a negative number turns this off."""
    waiting = error_jobs_with_artifacts(jobs, artifacts)
    limit = F.lit(now - dt.timedelta(days=max(days, 0)))
    return waiting.filter(F.lit(days >= 0) & (F.col("since") < limit))


def retention_plan(
    jobs: DataFrame, artifacts: DataFrame, now: dt.datetime, days: int = 30,
    max_bytes: int | None = None,
) -> DataFrame:
    """Jobs whose artifacts go: ``(job_id, since, size_bytes, reason)``.

    First all older than ``days``. Then, while the rest of the folder is above
    ``max_bytes``, the oldest failed job that is left; bytes of other jobs count too.
    """
    waiting = cut(error_jobs_with_artifacts(jobs, artifacts))  # read three times below
    limit = F.lit(now - dt.timedelta(days=max(days, 0)))
    is_old = F.lit(days >= 0) & F.coalesce(F.col("since") < limit, F.lit(False))
    columns = ["job_id", "since", "size_bytes"]
    aged = waiting.filter(is_old).select(*columns, F.lit(f"retention>{days}d").alias("reason"))
    if max_bytes is None:
        return aged
    left = with_row_number(waiting.filter(~is_old), [], [F.col("since"), F.col("id")], "_nth")
    freed = scan(left, [], "_nth", total={"_upto": F.col("size_bytes")})
    total = retained_bytes(artifacts).scalar()
    gone = aged.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).scalar()
    still = total - gone - (F.col("_upto") - F.col("size_bytes"))
    over = freed.filter(still > max_bytes).select(
        *columns, F.lit(f"size-limit>{max_bytes // 1024 // 1024}MB").alias("reason")
    )
    return aged.unionByName(over)
