"""From page-table cells to the text fragments of each student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions.text import is_blank, single_line, strip
from ..session import cut
from .joins import join_on
from .ordered import scan, with_row_number


# Rows are sorted by these keys; the page tells more of them apart than the file.
_COLUMN = ["page_no", "col_no", "file_id"]


def _split_headers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header cells (row 0 of each page) and the cells below them."""
    heads = raw.filter(F.col("row_no") == 0).select(*_COLUMN, F.col("cell").alias("header"))
    return heads, raw.filter(F.col("row_no") > 0)


def promote_headers(raw: DataFrame) -> DataFrame:
    """Row 0 of each page becomes the ``header`` of the cells below it."""
    heads, body = _split_headers(raw)
    return body.join(heads, _COLUMN).select(
        "file_id", "page_no", "row_no", "col_no", "header", "cell"
    )


def normalize_headers(cells: DataFrame) -> DataFrame:
    return cells.withColumn("header", single_line(F.col("header")))


def is_irrelevant(header: Column, names=G.IRRELEVANT_HEADERS) -> Column:
    """The header is one of ``names``, ignoring case, with an optional ``.n`` suffix."""
    choices = "|".join(rf"\Q{name}\E" for name in names)
    return F.coalesce(header.rlike(rf"(?i)^(?:{choices})(?:\.\d+)?$"), F.lit(False))


def drop_columns(cells: DataFrame, names=G.IRRELEVANT_HEADERS) -> DataFrame:
    return cells.filter(~is_irrelevant(F.col("header"), names))


def select_columns(cells: DataFrame, pattern: str = G.CODE_HEADER) -> DataFrame:
    """Keep the cells whose header matches ``pattern``."""
    return cells.filter(F.col("header").rlike(pattern))


def file_headers(cells: DataFrame, keyword: str = G.NAME_KEYWORD) -> DataFrame:
    """Per file: headers in column order, the name header, and the headers left of it.

    Column order is that of the union of the page tables: first page, then position.
    """
    # One number for (page, column) keeps this a hash aggregate.
    place = F.col("page_no").cast("long") * (1 << 31) + F.col("col_no")
    seen = cells.groupBy("file_id", "header").agg(F.min(place).alias("seen"))
    ordered = seen.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct("seen", "header"))).getField("header").alias("headers")
    )
    named = F.filter("headers", lambda h: F.contains(F.lower(h), F.lit(keyword.lower())))
    return ordered.withColumn("name_header", F.get(named, 0)).withColumn(
        "leading",
        F.slice("headers", 1, F.greatest(F.array_position("headers", F.col("name_header")) - 1, F.lit(0))),
    )


def column_roles(heads: DataFrame, keyword: str = G.NAME_KEYWORD) -> DataFrame:
    """Header cells with what their column is for, so that cells need one join only.

    Adds ``col_index`` (place among the file's columns), ``is_name``, ``is_leading`` (left
    of the name) and ``has_leading`` (the file has such columns). Columns of one page with
    the same header are different columns: the second of a page goes with the second of the
    other pages. Headers are cleaned and irrelevant ones left out; files without a name
    column or with a null header are left out too, see the outcome checks.
    """
    known = heads.groupBy("file_id").agg(F.bool_or(F.col("header").isNull()).alias("_null"))
    # One page's columns at a time.
    alike = Window.partitionBy("file_id", "page_no", "header").orderBy("col_no")
    kept = drop_columns(normalize_headers(heads)).withColumn("_nth", F.row_number().over(alike))
    place = F.col("page_no").cast("long") * (1 << 31) + F.col("col_no")
    columns = (
        kept.groupBy("file_id", "header", "_nth").agg(F.min(place).alias("seen"))
        .groupBy("file_id").agg(
            F.sort_array(F.collect_list(F.struct("seen", "header", "_nth"))).alias("_columns")
        )
    )
    index = F.expr("array_position(transform(_columns, c -> struct(c.header, c._nth)), struct(header, _nth))")
    named = F.filter("_columns", lambda c: F.contains(F.lower(c["header"]), F.lit(keyword.lower())))
    files = columns.withColumn("_name", F.get(named, 0)).filter(F.col("_name").isNotNull())
    files = join_on(files, known.filter("not _null"), ["file_id"], "left_semi").withColumn(
        "_at", F.array_position("_columns", F.col("_name"))
    )
    return join_on(kept, files, ["file_id"]).withColumn("col_index", index.cast("int")).select(
        "file_id", "page_no", "col_no", "header", "col_index",
        (F.col("header") == F.col("_name.header")).alias("is_name"),
        (F.col("col_index") < F.col("_at")).alias("is_leading"),
        (F.col("_at") > 1).alias("has_leading"),
    )


def table_rows(
    raw: DataFrame, keyword: str = G.NAME_KEYWORD, pattern: str | None = None
) -> DataFrame:
    """One row per table row, numbered from 0 in page order per file (``row_idx``).

    ``printed_name`` is the name cell, ``leading_blank`` tells whether all cells left of it
    are blank (null when there are none). ``parts`` holds the other non-blank cells,
    trimmed; with ``pattern``, those of the columns whose header matches it.
    """
    heads, body = _split_headers(raw)
    wanted = F.lit(True) if pattern is None else F.col("header").rlike(pattern)
    cells = body.join(column_roles(heads, keyword).withColumn("is_wanted", wanted), _COLUMN)
    filled = ~is_blank(F.col("cell"))
    part = F.struct(F.col("col_index").alias("col_no"), "header", strip(F.col("cell")).alias("text"))
    rows = cells.groupBy("row_no", "page_no", "file_id").agg(
        F.max(F.when(F.col("is_name"), F.col("cell"))).alias("printed_name"),
        F.when(
            F.bool_or("has_leading"), ~F.bool_or(F.col("is_leading") & filled)
        ).alias("leading_blank"),
        F.collect_list(F.when(~F.col("is_name") & F.col("is_wanted") & filled, part)).alias("parts"),
    )
    # A sort reads its input twice: for a sample of the keys, and for the rows.
    numbered = with_row_number(cut(rows), ["file_id"], [F.col("page_no"), F.col("row_no")], "row_idx")
    return numbered.select(
        "file_id", (F.col("row_idx") - 1).alias("row_idx"),
        "printed_name", "leading_blank", "parts",
    )


def fill_names(
    rows: DataFrame, keys: list[str], order: str, name: str, out: str = "student"
) -> DataFrame:
    """Copy each non-blank ``name`` down to the blank rows after it."""
    value = F.when(~is_blank(F.col(name)), F.col(name))
    return scan(rows, keys, order, last={out: value})


def glue_names(
    rows: DataFrame, keys: list[str], order: str, name: str, leading_blank: Column,
    out: str = "name",
) -> DataFrame:
    """Append name pieces to the name one row up.

    A piece is a non-blank name after row 0 whose leading cells are blank. It is appended
    when the row above still holds a name, which then leaves its own row without one; so in
    a run of pieces every second one is appended, from the first if a name precedes the run
    and from the second otherwise. ``order`` counts 0, 1, 2, ... within ``keys``.
    """
    at = F.col(order)
    named = ~is_blank(F.col(name))
    rows = rows.withColumn("_name", F.when(named, F.col(name))).withColumn(
        "_piece", named & (at > 0) & F.coalesce(leading_blank, F.lit(False))
    )
    seen = scan(
        rows, keys, order,
        last={"_anchor": F.when(
            ~F.col("_piece"),
            F.struct(at.alias("at"), F.col("_name").isNotNull().alias("named")),
        )},
        following={"_next": F.struct("_piece", "_name")},
    )
    nth = at - F.col("_anchor.at")  # place in the run of pieces, from 1; 0 outside a run
    parity = F.when(F.col("_anchor.named"), 1).otherwise(0)
    glued = F.col("_piece") & (nth % 2 == parity)
    takes_next = (
        F.coalesce(F.col("_next._piece"), F.lit(False))
        & F.col("_name").isNotNull()
        & ((nth + 1) % 2 == parity)
    )
    whole = F.when(glued, F.lit(None)).when(
        takes_next, F.concat_ws(" ", strip(F.col("_name")), strip(F.col("_next._name")))
    ).otherwise(F.col("_name"))
    return seen.withColumn(out, whole).drop("_name", "_piece", "_anchor", "_next")


def student_rows(
    raw: DataFrame, keyword: str = G.NAME_KEYWORD, strict_reference: bool = False,
    pattern: str | None = None,
) -> DataFrame:
    """Table rows with the student each belongs to; rows before the first name are dropped.

    With the name in the first column there are no leading cells. Then no piece is glued,
    unless ``strict_reference`` asks for the vacuous reading that takes them as blank.
    """
    rows = table_rows(raw, keyword, pattern)
    blank = F.coalesce("leading_blank", F.lit(strict_reference))
    glued = glue_names(rows, ["file_id"], "row_idx", "printed_name", blank, "_whole")
    start = F.when(
        F.col("_whole").isNotNull(),
        F.struct(F.col("_whole").alias("student"), F.col("row_idx").alias("first_row")),
    )
    filled = scan(glued, ["file_id"], "row_idx", last={"_start": start})
    return filled.filter(F.col("_start").isNotNull()).select(
        "file_id", "row_idx", "parts", "_start.*"
    )


def fragments(rows: DataFrame) -> DataFrame:
    """The trimmed non-blank cells of the student rows; the name column is left out."""
    ids = ["file_id", "student", "first_row", "row_idx"]
    return rows.select(*ids, F.explode("parts").alias("_p")).select(*ids, "_p.*")


def union_pages(*pages: DataFrame) -> DataFrame:
    """Union of wide page tables by column name; missing columns are null."""
    first, *rest = pages
    for page in rest:
        first = first.unionByName(page, allowMissingColumns=True)
    return first


def melt_columns(df: DataFrame, ids: list[str], pattern: str = G.CODE_HEADER) -> DataFrame:
    """Wide to long for the columns matching ``pattern``; null entries are dropped."""
    import re

    chosen = [c for c in df.columns if re.match(pattern, c)]
    # Column names hold blanks, brackets and dots, so they are quoted.
    quoted = [F.col(f"`{c}`").alias(c) for c in chosen]
    return df.unpivot(ids, quoted, "column_header", "entry").filter(F.col("entry").isNotNull())
