"""Current state of every job, kept up to date from a stream of lifecycle events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.jobs import job_state_columns
from .current import COMPACT, read_current, write_changes


def update_job_state(events: DataFrame, target: str, checkpoint: str, every: int = COMPACT) -> None:
    """Fold new events into the state and write the changed jobs of each batch.

    A job has no last event, so its state is kept for good: one row per job. The state is
    partitioned by job and lives in the checkpoint folder. A batch that runs again after a
    failure replaces itself; see :mod:`current` for how batches become one table.
    """
    state = events.groupBy("job_id").agg(*job_state_columns())

    def write(batch: DataFrame, batch_id: int) -> None:
        write_changes(batch, ["job_id"], target, batch_id, every=every)

    (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )


def read_job_state(spark: SparkSession, target: str) -> DataFrame:
    """Newest row of each job."""
    return read_current(spark, target)
