"""The detailed sheet: column layout per file and one value per student and column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions.text import blank_literal_na
from ..session import cut
from .joins import lookup
from .records import modules, placement_modules

FIRST_GRADE_COLUMN = 3  # after ``#`` and the student
CENTRE, EMPRESA, MODULE = 1, 2, 3  # place after a module's outcome columns (slot 0)


def module_conflicts(records: DataFrame) -> DataFrame:
    """Modules whose grade comes under more than one code, so that columns would collide.

    A code is a module's by its suffix, as in the sheet, whatever its record was found as.
    """
    codes = records.filter(G.column_kind(F.col("code")) == "MP").groupBy(
        "file_id", G.module_of(F.col("code")).alias("mp")
    ).agg(F.countDistinct("code").cast("int").alias("n_codes"))
    return codes.filter(F.col("n_codes") > 1)


def sheet_layout(records: DataFrame, type_a: DataFrame | None = None) -> DataFrame:
    """Grade columns per file: ``(file_id, col_pos, mp, slot, header, source_code)``.

    Modules in order; in each its outcome codes, then CENTRE, EMPRESA and MP for modules
    with company placement, else MP only. Modules without an outcome code get no column.
    Codes are told apart by their suffix, so ``..._01ra`` fills its module's own column.
    ``source_code`` names the records that fill the column: none for CENTRE, the last
    placement code for EMPRESA. The window below holds the columns of one sheet.
    """
    if type_a is None:
        type_a = placement_modules(records)
    codes = cut(records.select("file_id", "code", "kind").distinct())  # read four times
    by_code = codes.select("file_id", "code").distinct().select(
        "*", G.column_kind(F.col("code")).alias("kind"), G.module_of(F.col("code")).alias("mp")
    )
    listed = modules(codes)
    outcomes = by_code.join(listed, ["file_id", "mp"], "left_semi").filter(
        F.col("kind") == "RA"
    ).select(
        "file_id", "mp", F.lit(0).alias("slot"),
        F.col("code").alias("header"), F.col("code").alias("source_code"),
    )
    sources = by_code.filter(F.col("kind") != "RA").groupBy("file_id", "mp").agg(
        F.max(F.when(F.col("kind") == "EM", F.col("code"))).alias("em_code"),
        F.max(F.when(F.col("kind") == "MP", F.col("code"))).alias("mp_code"),
    )
    finals = (
        listed
        .join(type_a.withColumn("type_a", F.lit(True)), ["file_id", "mp"], "left")
        .join(sources, ["file_id", "mp"], "left")
    )
    centre = F.struct(
        F.lit(CENTRE).alias("slot"), F.concat("mp", F.lit(" CENTRE")).alias("header"),
        F.lit(None).cast("string").alias("source_code"),
    )
    empresa = F.struct(
        F.lit(EMPRESA).alias("slot"), F.concat("mp", F.lit(" EMPRESA")).alias("header"),
        F.col("em_code").alias("source_code"),
    )
    final = F.struct(
        F.lit(MODULE).alias("slot"), F.col("mp").alias("header"),
        F.col("mp_code").alias("source_code"),
    )
    slots = F.when(F.col("type_a"), F.array(centre, empresa, final)).otherwise(F.array(final))
    finals = finals.select("file_id", "mp", F.explode(slots).alias("s")).select(
        "file_id", "mp", "s.*"
    )
    by_place = Window.partitionBy("file_id").orderBy("mp", "slot", "header")
    return outcomes.unionByName(finals).withColumn(
        "col_pos", F.row_number().over(by_place) + (FIRST_GRADE_COLUMN - 1)
    )


def sheet_rows(records: DataFrame, layout: DataFrame, order: DataFrame) -> DataFrame:
    """One row per student with its grade cells in layout order.

    The grades of a student become one map, then each student row meets the single layout
    row of its file. ``cells`` holds ``(col_pos, mp, slot, header, grade_num, grade_text)``.
    """
    by_student = records.groupBy("file_id", "student").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "code", F.struct("grade_num", "grade_text")
        ))).alias("_grades")
    )
    columns = layout.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "col_pos", "mp", "slot", "header", "source_code"
        ))).alias("_columns")
    )
    rows = lookup(
        by_student.join(order, ["file_id", "student"]), columns, ["file_id"], "student"
    )
    # Looked up once per cell: a lambda works out an expression as often as it is written.
    found = F.transform(
        "_columns",
        lambda c: F.struct(c.alias("c"), F.try_element_at("_grades", c["source_code"]).alias("g")),
    )
    cells = F.transform(
        found,
        lambda x: F.struct(
            *[x["c"][n].alias(n) for n in ("col_pos", "mp", "slot", "header")],
            *[x["g"][n].alias(n) for n in ("grade_num", "grade_text")],
        ),
    )
    return rows.withColumn("cells", cells).drop("_grades", "_columns")


def sheet_cells(rows: DataFrame) -> DataFrame:
    """The sheet in long form: numbers stay numbers, ``NA`` and missing grades are blank.

    An inner ``explode`` would have Spark test the size of ``cells`` first, below the
    projections that make it, and so build the cells of each row a second time.
    """
    ids = [c for c in rows.columns if c != "cells"]
    num, text = F.col("_c.grade_num"), F.col("_c.grade_text")
    return rows.select(
        *[blank_literal_na(F.col(c)).alias(c) if c == "student" else c for c in ids],
        F.explode_outer("cells").alias("_c"),
    ).filter("_c is not null").select(
        *ids, "_c.col_pos", "_c.mp", "_c.slot", "_c.header", num.alias("grade_num"),
        F.when(num.isNull(), G.sheet_text(num, text)).alias("grade_text"),
        G.sheet_text(num, text).alias("value"),
    )
