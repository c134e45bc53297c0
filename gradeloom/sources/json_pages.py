"""Page tables as JSON lines, with a quarantine for lines that are no page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PAGE_LINES, RAW_CELLS

_BAD = "_corrupt_record"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines; what does not parse is kept as text. Missing fields are null."""
    schema = T.StructType([*PAGE_LINES.fields, T.StructField(_BAD, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", _BAD).json(path).withColumn(
        "reason",
        F.when(F.col(_BAD).isNotNull(), "malformed")
        .when(F.col("file_id").isNull(), "no_file_id")
        .when(F.col("page_no").isNull(), "no_page_no")
        .when(F.col("rows").isNull(), "no_rows"),
    )


def read_page_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells of the good lines (``schemas.RAW_CELLS``), and the lines put aside.

    A line is one page, ``{"file_id", "page_no", "rows": [[cell, ...], ...]}``; more fields
    are ignored. The lines put aside are ``file_id`` (null where unknown), ``page_no``,
    ``reason`` and ``line`` (the text of what does not parse). A page without rows has no cells
    and is not bad. Empty lines are no lines.
    """
    lines = _lines(spark, path)
    cells = (
        lines.filter("reason is null")
        .select("file_id", "page_no", F.posexplode("rows").alias("row_no", "_cells"))
        .select("file_id", "page_no", "row_no", F.posexplode("_cells").alias("col_no", "cell"))
    )
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_CELLS]
    bad = lines.filter("reason is not null").select("file_id", "page_no", "reason", F.col(_BAD).alias("line"))
    return cells.select(*typed), bad


def bad_reports(bad: DataFrame) -> DataFrame:
    """Reports that cannot be converted whole: ``(file_id, n_pages, reasons)``, for an anti-join.

    Lines without a known report are counted under a null ``file_id``.
    """
    return bad.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"),
    )
