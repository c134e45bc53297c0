"""Operations plans: overview, retention, sheet comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff, jobs as J
from ..operators.retention import retention_plan

__all__ = ["admin_counts", "admin_jobs", "admin_files", "retention_plan", "sheet_diff"]


def admin_counts(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """The six counts of the overview, in one row."""
    one = F.lit(1).alias("one")
    left = J.status_counts(jobs, "jobs").select("*", one)
    right = J.status_counts(files, "files").select("*", one)
    return left.join(right, "one").drop("one")


def admin_jobs(jobs: DataFrame, artifacts: DataFrame, limit: int = 100) -> DataFrame:
    """Newest jobs with their artifact flags; flags are looked up for those jobs only."""
    return J.present_jobs(J.recent(jobs, limit), artifacts)


def admin_files(files: DataFrame, limit: int = 200) -> DataFrame:
    return J.recent(files, limit)


def sheet_diff(left: DataFrame, right: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """Roll-up per sheet, and the first differences."""
    return diff.compare_sheets(left, right), diff.first_differences(left, right, limit)
