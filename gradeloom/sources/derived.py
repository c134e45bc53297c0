"""Report inputs derived from the star-schema tables, for the registered queries.

Customers play students, nations play reports, line items play grades. Everything is a
function of the rows, so both Spark and a plain SQL engine can rebuild it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut

STUDENTS_PER_PAGE = 32
ROWS_PER_STUDENT = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    """Largest and total quantity per student, module (0-5) and outcome (1-7)."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey",
        (F.col("l_suppkey") % 6).cast("int").alias("mp"),
        F.col("l_linenumber").alias("ra"),
        F.col("l_quantity").cast("int").alias("q"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .groupBy("o_custkey", "mp", "ra")
        .agg(F.max("q").alias("q"))
    )


def grades(spark: SparkSession, folder: str) -> DataFrame:
    """Known grades: ``(file_id, student_id, student, kind, code, grade_raw)``."""
    graded = _graded(spark, folder)
    # Students meet the numbers before texts are made of them, so narrow rows are sorted.
    outcomes = _with_student(spark, folder, graded)
    sums = graded.groupBy("o_custkey", "mp").agg(F.sum("q").alias("s"))
    modules = _with_student(spark, folder, sums)
    module = F.concat(
        F.lpad((F.lit(647) + F.col("mp")).cast("string"), 4, "0"),
        F.lit("_CF0"),
        (F.col("mp") % 3).cast("string"),
    )
    kind = F.when((F.col("ra") == 7) & (F.col("mp") % 2 == 0), "EM").otherwise("RA")
    low = F.when(F.col("ra") == 1, F.col("q") % 10 - 1).otherwise(F.col("q") % 10 + 1)
    outcomes = outcomes.select(
        "file_id", "student_id", "student", kind.alias("kind"),
        F.concat(module, F.lit("_0"), F.col("ra").cast("string"), kind).alias("code"),
        F.when(F.col("q") % 10 == 0, "PDT")
        .when(F.col("q") % 10 == 1, "EP")
        .when(F.col("q") % 10 == 2, "NA")
        .when(F.col("q") % 10 == 3, "")
        .otherwise(F.concat(F.lit("A"), low.cast("string")))
        .alias("grade_raw"),
    )
    mark = F.col("s") % 13
    modules = modules.select(
        "file_id", "student_id", "student", F.lit("MP").alias("kind"), module.alias("code"),
        F.when(mark == 0, "PQ")
        .when(mark == 1, "PDT")
        .when(mark == 2, "")
        .otherwise((mark - 2).cast("string"))
        .alias("grade_raw"),
    )
    return outcomes.unionByName(modules)


def _with_student(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("file_id"),
        F.col("c_custkey").alias("student_id"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("student"),
    )
    return rows.join(customers, F.col("o_custkey") == F.col("student_id")).drop("o_custkey")


GRADES_SQL = """
graded AS (
 SELECT o.o_custkey AS cust, CAST(l.l_suppkey % 6 AS INTEGER) AS mp, l.l_linenumber AS ra,
        max(CAST(l.l_quantity AS INTEGER)) AS q
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 GROUP BY ALL),
grades AS (
 SELECT c.c_nationkey AS file_id, c.c_custkey AS student_id,
        c.c_name || ' ' || c.c_mktsegment AS student, g.kind, g.code, g.grade_raw
 FROM (
  SELECT cust, kind,
         lpad(CAST(647 + mp AS VARCHAR), 4, '0') || '_CF0' || CAST(mp % 3 AS VARCHAR)
         || '_0' || CAST(ra AS VARCHAR) || kind AS code,
         CASE WHEN q % 10 = 0 THEN 'PDT' WHEN q % 10 = 1 THEN 'EP' WHEN q % 10 = 2 THEN 'NA'
              WHEN q % 10 = 3 THEN '' WHEN ra = 1 THEN 'A' || CAST(q % 10 - 1 AS VARCHAR)
              ELSE 'A' || CAST(q % 10 + 1 AS VARCHAR) END AS grade_raw
  FROM (SELECT *, CASE WHEN ra = 7 AND mp % 2 = 0 THEN 'EM' ELSE 'RA' END AS kind FROM graded)
  UNION ALL
  SELECT cust, 'MP', lpad(CAST(647 + mp AS VARCHAR), 4, '0') || '_CF0' || CAST(mp % 3 AS VARCHAR),
         CASE WHEN sum(q) % 13 = 0 THEN 'PQ' WHEN sum(q) % 13 = 1 THEN 'PDT'
              WHEN sum(q) % 13 = 2 THEN '' ELSE CAST(CAST(sum(q) % 13 - 2 AS INTEGER) AS VARCHAR) END
  FROM graded GROUP BY cust, mp) g
 JOIN customer c ON c.c_custkey = g.cust),
records AS (
 SELECT file_id, student_id, student, kind, code,
        CASE WHEN regexp_full_match(grade_raw, 'A?[0-9]+')
             THEN CAST(replace(grade_raw, 'A', '') AS DOUBLE) END AS grade_num,
        CASE WHEN NOT regexp_full_match(grade_raw, 'A?[0-9]+') THEN grade_raw END AS grade_text
 FROM grades)
"""


def grade_records(spark: SparkSession, folder: str) -> DataFrame:
    """The known grades in the shape of ``schemas.RECORDS`` (plus ``student_id``)."""
    from ..functions import grades as G

    raw = F.col("grade_raw")
    kind_no = F.when(F.col("kind") == "RA", 0).when(F.col("kind") == "EM", 1).otherwise(2)
    return grades(spark, folder).select(
        "file_id", "student_id", "student", "code", "kind",
        G.grade_num(raw).alias("grade_num"),
        G.grade_text(raw).alias("grade_text"),
        F.struct(
            kind_no.alias("kind_no"), F.lit(0).alias("col_no"),
            F.col("student_id").alias("first_row"),
            F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).alias("piece")).alias("part"),
            F.lit(0).alias("nth"),
        ).alias("pos"),
    )


def grade_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line of entry text per grade, numbered within the student.

    A student has at most one line per code, so the numbering window is bounded.
    """
    lines = grades(spark, folder)
    by_code = Window.partitionBy("file_id", "student_id").orderBy("code")
    return lines.select(
        "file_id", "student_id", "student",
        F.row_number().over(by_code).alias("line_no"),
        F.concat("code", F.lit(" (1) - "), "grade_raw").alias("line"),
    )


def raw_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Page tables as a report reader would deliver them (``schemas.RAW_CELLS``).

    Per student: one table row per grade, the name on the first row only. The last word of
    every fifth name slips to the next row, whose leading cells are blank. Row 0 of each
    page repeats the headers, with the line breaks and the irrelevant columns reports have;
    two columns have the same code header, each with grades of its own.
    """
    # Header cells and the cells below them are read apart, some more than once.
    lines = cut(grade_lines(spark, folder))
    slips = F.col("student_id") % 5 == 0
    first = F.col("line_no") == 1
    name = (
        F.when(first & slips, F.substring_index("student", " ", 1))
        .when(first, F.col("student"))
        .when((F.col("line_no") == 2) & slips, F.substring_index("student", " ", -1))
        .otherwise("")
    )
    place = [
        "file_id",
        (F.col("student_id") / STUDENTS_PER_PAGE).cast("int").alias("page_no"),
    ]
    row_no = (
        1 + F.col("student_id") % STUDENTS_PER_PAGE * ROWS_PER_STUDENT + F.col("line_no")
    ).cast("long")
    number = F.col("student_id").cast("string")
    other = F.col("line_no") % 3 == 0  # these grades stand in the second code column
    body = lines.select(
        *place,
        row_no.alias("row_no"),
        F.posexplode(F.array(
            F.when(first, number).otherwise(""),
            F.when(first, F.concat(F.lit("ID "), number)).otherwise(""),
            name,
            F.lit("x"),
            F.when(~other, F.concat(F.lit("  "), "line", F.lit(" \n"))).otherwise(" "),
            F.when(other, F.concat("line", F.lit("\n"))).otherwise(""),
        )).alias("col_no", "cell"),
    )
    # Header cells of a report page.
    heads = [
        " Núm. ", "Identificador", "Nom\ni cognoms ", "MC.1", " Codi (Conv)\n- Qual ",
        "Codi (Conv) - Qual",
    ]
    pages = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("file_id"),
        (F.col("c_custkey") / STUDENTS_PER_PAGE).cast("int").alias("page_no"),
    ).distinct()
    top = pages.select(
        "*", F.lit(0).cast("long").alias("row_no"),
        F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("col_no", "cell"),
    )
    return top.unionByName(body)


#: What damage does to a report; :func:`damaged_cells` makes it, in this order from 1.
DAMAGE = ["no_tables", "null_header", "no_name_column", "no_outcome_codes", "duplicate_grades"]


def damaged_cells(cells: DataFrame, kind) -> DataFrame:
    """Page cells as bad reports have them; ``kind`` counts :data:`DAMAGE` from 1, else they stay."""
    head, column = F.col("row_no") == 0, F.col("col_no")
    cell = (
        F.when(head & (kind == 2) & (column == 3), F.lit(None))
        .when(head & (kind == 3) & (column == 2), "Alumnat").otherwise(F.col("cell"))
    )
    copies = F.when(kind == 5, F.array(F.lit(0), F.lit(1 << 20))).otherwise(F.array(F.lit(0)))
    return (
        cells.filter((kind != 1) & ((kind != 4) | head))
        .withColumns({"cell": cell, "_copy": F.explode(copies)})
        .withColumn("page_no", F.col("page_no") + F.col("_copy")).drop("_copy")
    )


def outcome_sql(kind: str) -> str:
    """CTE ``told``: what becomes of the report of each nation, damaged as ``kind`` says (of ``k``)."""
    return f"""seen AS (
 SELECT n.n_nationkey AS k, bool_or(c.c_custkey IS NOT NULL) AS has_pages,
  coalesce(bool_or(r.kind = 'RA'), FALSE) AS has_ra, count(r.code) AS n
 FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN records r ON r.student_id = c.c_custkey
 GROUP BY 1),
reasons AS (
 SELECT k AS file_id, n, CASE WHEN NOT has_pages OR {kind} = 1 THEN 'no_tables' WHEN {kind} = 2 THEN 'null_header'
  WHEN {kind} = 3 THEN 'no_name_column' WHEN {kind} = 4 OR NOT has_ra THEN 'no_outcome_codes'
  WHEN {kind} = 5 THEN 'duplicate_grades' END AS reason FROM seen),
told AS (
 SELECT file_id, CASE WHEN reason IS NULL THEN 'success' ELSE 'error' END AS status, reason,
  CASE reason WHEN 'no_tables' THEN 'No objects to concatenate' WHEN 'null_header' THEN 'expected string or bytes-like object'
   WHEN 'no_name_column' THEN '' WHEN 'no_outcome_codes' THEN '''code'''
   WHEN 'duplicate_grades' THEN 'Index contains duplicate entries, cannot reshape' END AS error_message,
  CASE WHEN reason = 'null_header' THEN 'El fitxer no té l''estructura esperada d''una acta.'
   WHEN reason = 'no_tables' THEN 'No s''han pogut extreure les taules necessàries del PDF.'
   WHEN reason IS NOT NULL THEN 'No s''ha pogut convertir aquest fitxer perquè no té el format esperat o hi ha hagut un error durant el procés.'
  END AS public_message, CASE WHEN reason IS NULL THEN n ELSE 0 END AS n_records FROM reasons)"""
