"""Readers and writers of the package's tables and of report folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import file_name, strip
from ..operators.jobs import with_missing_columns
from ..operators.naming import content_type, unique_names

# The line above the group code, and the code of reports without one.
GROUP_MARKER = "Codi del grup"
UNKNOWN_GROUP = "unknown_group"


def list_reports(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Manifest of a folder, by path: ``(path, name, size_bytes, modified_at)``.

    The contents are never read. An empty folder is an error, as for the batch command.
    Files of no bytes are not listed; Spark's reader leaves them out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = files.select(
        "path", file_name(F.col("path")).alias("name"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
    )
    if found.isEmpty():
        raise FileNotFoundError("No PDF files found in the input directory.")
    return found.orderBy("path")


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """All files under a folder of retained jobs: ``(job_id, path, size_bytes)``.

    The first folder level below ``folder`` is the job.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )
    inside = F.substring_index("path", folder.rstrip("/") + "/", -1)
    return files.select(
        F.substring_index(inside, "/", 1).alias("job_id"), "path",
        F.col("length").alias("size_bytes"),
    )


def read_table(spark: SparkSession, name: str, path: str, kind: str = "parquet") -> DataFrame:
    """One of the tables of :mod:`gradeloom.schemas`, with its fixed schema."""
    schema = getattr(schemas, name.upper())
    return spark.read.schema(schema).format(kind).load(path).select(*schema.names)


def read_generations(spark: SparkSession, name: str, path: str, defaults: dict) -> DataFrame:
    """A table whose older files lack columns, brought to its present schema.

    The schemas of all files are merged; what no file has is added with its type, and nulls
    of the columns in ``defaults`` get their default.
    """
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return with_missing_columns(found, getattr(schemas, name.upper()), defaults).na.fill(defaults)


def append_rows(df: DataFrame, name: str, path: str, batch: str) -> None:
    """Append one batch to an audit table, in the column order of its schema, exactly once.

    A batch has a folder of its own under ``path``; the folders are the ledger. Writing a
    batch again, after a failure for instance, replaces its folder and no other row.
    """
    columns = getattr(schemas, name.upper()).names
    df.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_lookup(df: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """Write a table for lookups of single keys.

    The files are ranges of ``key``, so their statistics tell a reader which of them to open,
    and a Parquet bloom filter rules out the row groups that lack a key inside their range.
    Rows of one key may span files.
    """
    ranges = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    (
        ranges.sortWithinPartitions(key).write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    )


def new_jobs(requests: DataFrame, now: Column) -> DataFrame:
    """Audit rows of accepted requests; the rest of the columns stays null."""
    return requests.select(
        "id", "job_id", "request_type", "source_name", "source_size_bytes",
        "source_file_count", "remote_addr", F.lit("received").alias("status"),
        F.lit(0).alias("progress_current"), F.lit(1).alias("progress_total"),
        now.alias("created_at"), now.alias("updated_at"),
    )


#: Student rows of a sheet that go to one file.
SHEET_ROWS = 100_000


def write_sheets(cells: DataFrame, path: str) -> None:
    """Detailed sheets in long form, one folder per report.

    Keyed by ``file_id``: two reports with one group code do not overwrite each other. A
    report that is written again replaces its own folder; reports written before stay. The
    rows of a report go to one file, those of a big one to a file per ``SHEET_ROWS`` rows.
    """
    share = F.expr(f"`row_no` div {SHEET_ROWS}")
    (
        cells.repartition("file_id", share)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("file_id").parquet(path)
    )


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Sheets in long form, as :func:`write_sheets` leaves them, with a fixed schema."""
    return spark.read.schema(schemas.SHEET).parquet(path)


def group_code(text: Column, marker: str = GROUP_MARKER) -> Column:
    """The trimmed line after the first line with the marker, blanks as ``_``."""
    lines = F.split(text, "\n")
    marked = F.transform(
        F.slice(lines, 1, F.size(lines) - 1), lambda line: F.contains(line, F.lit(marker))
    )
    at = F.array_position(marked, True)
    code = F.replace(strip(F.get(lines, at.cast("int"))), F.lit(" "), F.lit("_"))
    return F.when(at > 0, code).otherwise(UNKNOWN_GROUP)


def bundle_manifest(outputs: DataFrame) -> DataFrame:
    """Names and content types in a download bundle: ``(job_id, pos, output_name)`` in."""
    return unique_names(outputs, "job_id", "pos", "output_name", "bundle_name").withColumn(
        "content_type", content_type(F.col("bundle_name"))
    )
