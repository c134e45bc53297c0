"""Audit tables: job state from lifecycle events, lists, counts and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status each lifecycle event writes.
EVENT_STATUS = {
    "created": "received", "started": "processing", "success": "success", "error": "error",
}


def _latest(value: Column, *events: str) -> Column:
    """Value of the newest of these events, null included."""
    return F.max_by(value, F.when(F.col("event").isin(*events), F.col("seq")))


def job_state_columns() -> list[Column]:
    """Aggregates that fold the events of a job into its current row, ordered by ``seq``."""
    status = None
    for event, value in EVENT_STATUS.items():
        hit = F.col("event") == event
        status = F.when(hit, value) if status is None else status.when(hit, value)
    c = F.col
    return [
        _latest(c("request_type"), "created").alias("request_type"),
        _latest(c("source_name"), "created").alias("source_name"),
        _latest(c("source_size_bytes"), "created").alias("source_size_bytes"),
        _latest(c("source_file_count"), "created", "source_count").alias("source_file_count"),
        _latest(c("remote_addr"), "created").alias("remote_addr"),
        _latest(status, *EVENT_STATUS).alias("status"),
        _latest(c("returned_name"), "success").alias("returned_name"),
        _latest(c("returned_file_count"), "success").alias("returned_file_count"),
        _latest(c("error_message"), "error").alias("error_message"),
        _latest(c("debug_path"), "error", "artifact").alias("debug_path"),
        _latest(F.coalesce("metadata_json", F.lit("{}")), "progress", "error", "artifact").alias("metadata_json"),
        _latest(c("stage"), "progress").alias("stage"),
        _latest(c("progress_message"), "progress").alias("progress_message"),
        F.coalesce(_latest(c("progress_current"), "progress"), F.lit(0)).alias("progress_current"),
        F.coalesce(_latest(c("progress_total"), "progress"), F.lit(1)).alias("progress_total"),
        _latest(c("ts"), "created").alias("created_at"),
        _latest(c("ts"), "started").alias("started_at"),
        _latest(c("ts"), "success", "error").alias("completed_at"),
        _latest(c("ts"), "success").alias("returned_at"),
        F.max_by("ts", "seq").alias("updated_at"),
    ]


def fold_events(events: DataFrame) -> DataFrame:
    """Current row of every job; partial results are combined before the shuffle."""
    return events.groupBy("job_id").agg(*job_state_columns())


def status_counts(df: DataFrame, what: str) -> DataFrame:
    """``total_/success_/error_<what>``; the two sums are null for an empty table."""
    def matching(status: str) -> Column:
        return F.sum(F.when(F.col("status") == status, 1).otherwise(0)).alias(f"{status}_{what}")

    return df.agg(F.count(F.lit(1)).alias(f"total_{what}"), matching("success"), matching("error"))


def recent(df: DataFrame, limit: int) -> DataFrame:
    """Newest rows first; rows of the same second by descending ``id``."""
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def reference_time() -> Column:
    return F.coalesce("completed_at", "created_at")


def error_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "error")


def error_jobs_oldest_first(jobs: DataFrame) -> DataFrame:
    return error_jobs(jobs).orderBy(reference_time(), "id")


def find_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def progress_view(jobs: DataFrame) -> DataFrame:
    """Progress columns of the status reply; the percentage is cut, not rounded."""
    total = F.greatest(F.coalesce(F.nullif("progress_total", F.lit(0)), F.lit(1)), F.lit(1))
    current = F.least(F.coalesce("progress_current", F.lit(0)), F.col("total"))
    return jobs.withColumn("total", total).withColumn("current", current).select(
        "job_id", "status",
        F.coalesce("stage", F.lit("")).alias("stage"),
        F.coalesce("progress_message", F.lit("")).alias("message"),
        F.col("current").alias("progress_current"),
        F.col("total").alias("progress_total"),
        (F.col("current") / F.col("total") * 100).cast("int").alias("percent"),
        (F.col("status") == "success").alias("download_ready"),
    )


def metadata_map(raw: Column) -> Column:
    """JSON object as a map of texts; empty for anything else."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(raw, "map<string,string>"), empty)


def existing_paths(artifacts: DataFrame) -> DataFrame:
    """Every listed file and the folders above it, once each, for a semi join."""
    files = artifacts.select("path")
    folders = files.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct()
    parts = F.split("folder", "/")
    upper = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    return files.distinct().unionByName(folders.select(F.explode(upper).alias("path")).distinct())


def artifact_flags(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Which retained paths of a job exist: ``(job_id, has_debug_path, has_failed_source,
    has_failure_log)``. Jobs without any path on disk have no row."""
    meta = metadata_map(F.col("metadata_json"))
    kinds = {
        "has_debug_path": F.col("debug_path"),
        "has_failed_source": F.try_element_at(meta, F.lit("failed_source_path")),
        "has_failure_log": F.try_element_at(meta, F.lit("failure_log_path")),
    }
    named = jobs.select(
        "job_id",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("kind"), p.alias("path")) for k, p in kinds.items()
        ])).alias("c"),
    ).select("job_id", "c.kind", "c.path").filter(F.col("path") != "")
    present = named.join(existing_paths(artifacts), ["path"], "left_semi")
    return present.groupBy("job_id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in kinds])


def present_jobs(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Jobs with the flags and the deletion note the overview shows."""
    flags = artifact_flags(jobs, artifacts)
    meta = metadata_map(F.col("metadata_json"))
    return jobs.join(flags, ["job_id"], "left").withColumns({
        "has_failed_source": F.coalesce("has_failed_source", F.lit(False)),
        "has_failure_log": F.coalesce("has_failure_log", F.lit(False)),
        "artifacts_deleted_at": F.try_element_at(meta, F.lit("artifacts_deleted_at")),
    }).drop("has_debug_path")


def jobs_with_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Each job with the counts of its file rows; file rows are combined first."""
    counts = files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("status") == "error").alias("n_failed"),
    )
    return jobs.join(counts, ["job_id"], "left").na.fill(0, ["n_files", "n_failed"])


def with_missing_columns(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Add the columns an older table lacks, typed, with a default or null."""
    have = set(df.columns)
    added = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema if f.name not in have
    }
    return df.withColumns(added).select(*schema.names) if added else df.select(*schema.names)
