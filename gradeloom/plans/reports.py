"""Report plans: cells to records, records to sheets and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grades import CODE_HEADER
from ..operators import layout, outcomes, pending, records as rec, summary, tables
from ..operators.joins import lookup
from ..operators.ordered import ordered_text
from ..session import cut
from ..sources.catalog import bundled_names


def report_fragments(
    raw_cells: DataFrame, strict_reference: bool = False, pattern: str | None = None
) -> DataFrame:
    """Raw page cells to trimmed text fragments with the student each belongs to."""
    rows = tables.student_rows(raw_cells, strict_reference=strict_reference, pattern=pattern)
    return tables.fragments(rows)


def merged_rows(raw_cells: DataFrame, strict_reference: bool = False) -> DataFrame:
    """All columns of each student as one text: ``(file_id, student, col_no, header, entry)``."""
    parts = report_fragments(raw_cells, strict_reference)
    return ordered_text(parts, ["file_id", "student", "col_no", "header"], "row_idx", "text", "entry")


def extract_records(raw_cells: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Raw page cells to grade records of every report."""
    codes = report_fragments(raw_cells, strict_reference, CODE_HEADER)
    pieces = rec.entry_pieces(codes)
    return rec.tidy_names(rec.extract_records(pieces, ["file_id", "student"]))


def convert_reports(
    raw_cells: DataFrame, files: DataFrame, strict_reference: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Records of the good reports among ``files``, and what became of each of them.

    ``files`` is the manifest, ``(file_id, ...)``: a report without any cell has no row
    elsewhere. Header cells are judged first, and only reports they say nothing against are
    extracted; reports without outcome codes or with duplicate grades then drop out too.
    """
    heads = raw_cells.filter("row_no = 0").select("file_id", F.col("cell").alias("header"))
    faults = cut(outcomes.header_faults(files, heads))
    sound = faults.filter("reason is null").select("file_id")
    cells = lookup(raw_cells, sound, ["file_id"], "row_no", "left_semi", written=True)
    records = cut(extract_records(cells, strict_reference))
    told = cut(outcomes.file_outcomes(faults, records))
    good = told.filter("status = 'success'").select("file_id")
    return lookup(records, good, ["file_id"], "student", "left_semi", written=True), told


def detailed_sheet(records: DataFrame, type_a: DataFrame | None = None) -> DataFrame:
    """Rows of the detailed sheet of every report without duplicate grades."""
    clean = rec.files_without_duplicates(records)
    return layout.sheet_rows(
        clean, layout.sheet_layout(clean, type_a), rec.student_order(clean)
    )


def pending_summary(records: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Outcomes still owed, one text per student."""
    names = bundled_names(records.sparkSession) if names is None else names
    records = cut(records)  # read twice: for the order and for the outcomes
    return pending.pending_summary(records, rec.student_order(records), names)


def final_grade_summary(sheet_rows: DataFrame) -> DataFrame:
    """Final column of every module, with status and range check."""
    return summary.final_summary_of_rows(sheet_rows)


def edited_sheet_summary(cells: DataFrame) -> DataFrame:
    """Final columns of sheets that staff edited and wrote back (long form).

    A sheet ends at its first row without a student and without any value; what stands
    below it, a legend for instance, does not count.
    """
    shown = F.nullif(F.coalesce(F.nullif("student", F.lit("")), "value"), F.lit(""))
    kept = summary.cut_at_blank_row(cells.withColumn("_shown", shown), "file_id", "row_no", "_shown")
    return summary.final_summary(kept.drop("_shown"))
