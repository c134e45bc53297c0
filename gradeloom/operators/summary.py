"""Final-grade summary: one final column per module, cut, checked and rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades as G
from .joins import lookup
from .layout import CENTRE, MODULE, sheet_cells


def cut_at_blank_row(cells: DataFrame, sheet: str, row: str, value: str) -> DataFrame:
    """Keep the rows above the first row of a sheet in which every cell is null."""
    filled = cells.groupBy(sheet, row).agg(F.count(value).alias("_n"))
    ends = filled.filter(F.col("_n") == 0).groupBy(sheet).agg(F.min(row).alias("_end"))
    return lookup(cells, ends, [sheet], row, "left").filter(
        F.col("_end").isNull() | (F.col(row) < F.col("_end"))
    ).drop("_end")


def final_columns(headers: DataFrame) -> DataFrame:
    """Per file and module the column to keep: CENTRE if there is one, else the module's.

    Modules that show up in outcome or EMPRESA headers only are left out.
    """
    known = headers.select("file_id", "header").distinct().withColumn(
        "mp", G.summary_module(F.col("header"))
    ).filter(F.col("mp").isNotNull())
    return known.groupBy("file_id", "mp").agg(
        F.bool_or(F.endswith("header", F.lit(" CENTRE"))).alias("type_a"),
        F.bool_or(F.col("header") == F.col("mp")).alias("_plain"),
    ).filter(F.col("type_a") | F.col("_plain")).select(
        "file_id", "mp", "type_a",
        F.when(F.col("type_a"), F.concat("mp", F.lit(" CENTRE"))).otherwise(F.col("mp")).alias("header"),
    )


def final_summary_of_rows(rows: DataFrame) -> DataFrame:
    """Long summary of detailed sheet rows.

    A row holds every column of its sheet, so its final columns are picked in place.
    """
    placed = F.transform(
        F.filter("cells", lambda c: c["slot"] == CENTRE), lambda c: c["mp"]
    )
    ids = [c for c in rows.columns if c != "cells"]
    listed = sheet_cells(rows.select(*ids, F.filter(
        "cells", lambda c: c["slot"].isin(CENTRE, MODULE)
    ).alias("cells")).withColumn("_placed", placed))
    has_centre = F.array_contains("_placed", F.col("mp"))
    finals = listed.filter((F.col("slot") == CENTRE) | ((F.col("slot") == MODULE) & ~has_centre))
    return _checked(finals.withColumn("type_a", F.col("slot") == CENTRE))


def final_summary(cells: DataFrame) -> DataFrame:
    """Long summary of sheet cells ``(file_id, row_no, student, header, grade_num, grade_text)``."""
    grades = cells.select("file_id", "row_no", "student", "header", "grade_num", "grade_text")
    kept = lookup(grades, final_columns(cells), ["file_id", "header"], "row_no")
    return _checked(kept)


def _checked(finals: DataFrame) -> DataFrame:
    num, text, header = F.col("grade_num"), F.col("grade_text"), F.col("header")
    return finals.select(
        "file_id", "row_no", "student", "mp", "header", "type_a", "grade_num", "grade_text",
        G.rounded_display(num, text, header).alias("shown"),
        G.summary_status(num, text, header).alias("status"),
        (~G.in_range(num, text, header)).alias("out_of_range"),
    )
