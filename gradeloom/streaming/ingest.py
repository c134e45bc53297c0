"""Reports are taken in as they arrive; a bad one becomes a row and stops nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import lookup
from ..operators.layout import sheet_cells
from ..plans.reports import convert_reports, detailed_sheet
from ..schemas import MANIFEST, RAW_CELLS
from ..session import cut
from .current import COMPACT, read_current, write_changes

#: Tables an ingest keeps below its target.
RECORDS, OUTCOMES, SHEETS = "records", "outcomes", "sheets"


def ingest_reports(
    spark: SparkSession, manifest: str, cells: str, target: str, checkpoint: str,
    schema: T.StructType = MANIFEST, cell_schema: T.StructType = RAW_CELLS,
    files_per_batch: int | None = None, every: int = COMPACT,
) -> None:
    """Take in every report that new files of the ``manifest`` folder name, once each.

    A row of the manifest is one arrival of a report: ``(file_id, arrival, job_id,
    source_name)``. Its page cells stand in ``cells`` under the same ``arrival`` (a partition
    folder or a column) and are complete before the manifest names them; a report without
    any is one without tables. Records, sheets and one outcome per report go to tables below
    ``target``. A report that comes again replaces what it left before, also when it is bad
    now: then only its outcome is left. Of several arrivals in one batch the highest counts.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    with_arrival = T.StructType([*cell_schema.fields, T.StructField("arrival", T.LongType())])

    def process(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != "file_id"]
        newest = cut(
            batch.groupBy("file_id").agg(F.max_by(F.struct(*rest), "arrival").alias("_row"))
            .select("file_id", "_row.*")
        )
        first, last = newest.agg(F.min("arrival"), F.max("arrival")).first()
        arrived = spark.read.schema(with_arrival).parquet(cells).filter(
            F.col("arrival").between(first, last)  # skips the folders of other arrivals
        )
        own = newest.select("file_id", "arrival")
        raw = lookup(arrived, own, ["file_id", "arrival"], "row_no", "left_semi", written=True)
        records, outcomes = convert_reports(raw.drop("arrival"), newest)
        records = cut(records)
        for name, rows in (
            (RECORDS, records), (SHEETS, sheet_cells(detailed_sheet(records))), (OUTCOMES, outcomes),
        ):
            write_changes(rows, ["file_id"], f"{target}/{name}", batch_id, newest, every)

    (
        reader.parquet(manifest)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(process)
        .start()
        .awaitTermination()
    )


def read_ingested(spark: SparkSession, target: str, name: str) -> DataFrame:
    """What holds now in one of the tables of an ingest."""
    return read_current(spark, f"{target}/{name}")
