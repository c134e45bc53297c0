"""Positional comparison of two versions of sheets in cell form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["sheet_id", "row_no", "col_no"]


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells that differ; a missing cell equals an empty one. Both sides: PLACE + ``value``."""
    both = left.withColumnRenamed("value", "left_value").join(
        right.withColumnRenamed("value", "right_value"), PLACE, "full_outer"
    )
    return both.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def first_differences(left: DataFrame, right: DataFrame, limit: int = 20) -> DataFrame:
    """The first differences, row by row."""
    return differences(left, right).orderBy(*PLACE).limit(limit)


def compare_sheets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per sheet: same dimensions, same headers (row 1), and how many cells differ."""
    def extent(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("sheet_id").agg(
            F.max("row_no").alias(f"{name}_rows"), F.max("col_no").alias(f"{name}_cols")
        )

    found = differences(left, right).groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("n_diffs"),
        F.count_if(F.col("row_no") == 1).alias("_head_diffs"),
    )
    joined = extent(left, "left").join(extent(right, "right"), ["sheet_id"], "full_outer").join(
        found, ["sheet_id"], "left"
    )
    same_size = F.col("left_rows").eqNullSafe(F.col("right_rows")) & F.col(
        "left_cols"
    ).eqNullSafe(F.col("right_cols"))
    same_width = F.col("left_cols").eqNullSafe(F.col("right_cols"))
    return joined.select(
        "sheet_id", "left_rows", "left_cols", "right_rows", "right_cols",
        same_size.alias("same_dimensions"),
        (same_width & (F.coalesce("_head_diffs", F.lit(0)) == 0)).alias("same_headers"),
        F.coalesce("n_diffs", F.lit(0)).alias("n_diffs"),
    )


def compare_titled(
    left: DataFrame, right: DataFrame, left_titles: DataFrame, right_titles: DataFrame
) -> DataFrame:
    """:func:`compare_sheets` with ``left_title``, ``right_title`` and whether they are the same.

    Titles are ``(sheet_id, title)``, one row for each sheet; a sheet may have a title and no cells.
    """
    titles = left_titles.withColumnRenamed("title", "left_title").join(
        right_titles.withColumnRenamed("title", "right_title"), ["sheet_id"], "full_outer"
    )
    # A sheet without a cell on either side has nothing that could differ.
    return titles.join(compare_sheets(left, right), ["sheet_id"], "full_outer").withColumn(
        "same_sheet_title", F.col("left_title").eqNullSafe(F.col("right_title"))
    ).na.fill(True, ["same_dimensions", "same_headers"]).na.fill(0, ["n_diffs"])
