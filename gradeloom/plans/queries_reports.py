"""Registered queries over reports: extraction, sheets, pending outcomes and review."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions.text import clean_entry, spanish_key, strip
from ..operators import layout, ordered, records as rec, summary, tables
from ..session import shared_folder
from ..sources import derived as D, synthetic
from ..sources.catalog import bundled_names, with_module_label
from ..sources.files import group_code, read_sheets, write_sheets
from . import reports
from .oracle_text import CATALOG_VALUES, SQL_BLANK, SQL_KEY, sql_strip

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL counterpart."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


_RECORDS_SQL = f"""WITH {D.GRADES_SQL}
SELECT file_id, student, kind, code, grade_num, grade_text FROM records"""


@query(_RECORDS_SQL)
def extract_records(spark: SparkSession, folder: str) -> DataFrame:
    """Entry text of each student back to its grades."""
    lines = D.grade_lines(spark, folder)
    entries = ordered.ordered_text(
        lines, ["file_id", "student_id", "student"], "line_no", "line", "entry"
    )
    return rec.extract_records(entries, ["file_id", "student"]).drop("pos", "capital_em")


@query(_RECORDS_SQL)
def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """Page cells, with split names and blank name cells, back to grades."""
    return reports.extract_records(D.raw_cells(spark, folder)).drop("pos", "capital_em")


_PENDING_SQL = f"""
owed AS (
 SELECT DISTINCT file_id, student, code, split_part(code, '_', 1) AS mp,
        regexp_extract(code, '[0-9]+RA$') AS outcome
 FROM records WHERE kind = 'RA'
  AND (grade_num < 5 OR upper(grade_text) IN ('PDT', 'EP', 'NA', 'PQ'))),
lines AS (
 SELECT file_id, student, mp,
        string_agg('- RA' || CAST(CAST(replace(outcome, 'RA', '') AS INTEGER) AS VARCHAR), chr(10)
                   ORDER BY CAST(replace(outcome, 'RA', '') AS INTEGER), outcome) AS lines
 FROM owed GROUP BY ALL),
texts AS (
 SELECT file_id, student,
        string_agg(mp || coalesce('. ' || n.mp_name, '') || ':' || chr(10) || lines,
                   chr(10) || chr(10) ORDER BY mp) AS pending
 FROM lines LEFT JOIN names n ON n.mp_code = mp GROUP BY ALL)
"""


@query(f"""WITH {D.GRADES_SQL}, names AS ({CATALOG_VALUES}), {_PENDING_SQL},
students AS (SELECT DISTINCT file_id, student FROM records)
SELECT s.file_id, row_number() OVER (PARTITION BY s.file_id ORDER BY {SQL_KEY.format('s.student')}) AS row_no,
       s.student, coalesce(t.pending, '') AS pending, '' AS notes
FROM students s LEFT JOIN texts t ON t.file_id = s.file_id AND t.student = s.student""")
def pending_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Which outcomes does each student still owe?"""
    return reports.pending_summary(D.grade_records(spark, folder))


# --- cells and names -------------------------------------------------------------------

@query(f"""SELECT conv_id AS conv_id,
 coalesce(string_agg(nullif({sql_strip('text')}, ''), chr(10) ORDER BY turn), '') AS entry
FROM conversations GROUP BY conv_id""")
def entry_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed texts of each conversation, joined in order."""
    turns = D.table(spark, folder, "conversations").select(
        "conv_id", "turn", strip(F.col("text")).alias("text")
    )
    return ordered.ordered_text(turns, ["conv_id"], "turn", "text", "entry")


@query("""SELECT user_id, event_id,
 last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id) AS student FROM events""")
def name_ffill(spark: SparkSession, folder: str) -> DataFrame:
    """Names printed on every third row only, copied down."""
    rows = D.table(spark, folder, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ").alias("printed"),
    )
    return tables.fill_names(rows, ["user_id"], "event_id", "printed").drop("printed")


@query("""WITH RECURSIVE src AS (
 SELECT user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS name,
        event_id % 3 <> 0 AS leading_blank,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
walk(user_id, i, named) AS (
 SELECT user_id, i, name IS NOT NULL FROM src WHERE i = 0
 UNION ALL
 SELECT s.user_id, s.i, s.name IS NOT NULL AND NOT (s.leading_blank AND w.named)
 FROM walk w JOIN src s ON s.user_id = w.user_id AND s.i = w.i + 1),
joined AS (
 SELECT s.user_id, s.event_id, s.i, s.name, w.named,
        lead(s.name IS NOT NULL AND NOT w.named) OVER u AS next_glued,
        lead(s.name) OVER u AS next_name
 FROM src s JOIN walk w ON w.user_id = s.user_id AND w.i = s.i
 WINDOW u AS (PARTITION BY s.user_id ORDER BY s.i)),
glued AS (
 SELECT user_id, event_id, i,
        CASE WHEN named AND next_glued THEN name || ' ' || next_name WHEN named THEN name END AS name
 FROM joined)
SELECT user_id, event_id, name, last_value(name IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY i) AS student FROM glued""")
def name_glue(spark: SparkSession, folder: str) -> DataFrame:
    """Name pieces on rows with blank leading cells, glued to the row above."""
    rows = D.table(spark, folder, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).otherwise("").alias("printed"),
        (F.col("event_id") % 3 != 0).alias("leading_blank"),
    )
    rows = ordered.with_row_number(rows, ["user_id"], [F.col("event_id")], "nth")
    rows = rows.withColumn("row_idx", F.col("nth") - 1)
    glued = tables.glue_names(rows, ["user_id"], "row_idx", "printed", F.col("leading_blank"))
    filled = tables.fill_names(glued, ["user_id"], "row_idx", "name")
    return filled.select("user_id", "event_id", "name", "student")


@query(f"""SELECT doc_id, {sql_strip(f"regexp_replace(text, '{SQL_BLANK}*{chr(92)}n{SQL_BLANK}*', ' ', 'g')")} AS header
FROM documents""")
def headers_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Multi-line headers on one line (here: whole documents)."""
    texts = D.table(spark, folder, "documents").select("doc_id", F.col("text").alias("header"))
    return tables.normalize_headers(texts)


def _part_headers(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("p_partkey") % 10
    # Header variants around the irrelevant and the code columns.
    variants = [
        "MC", "MC.1", "h", "Pas de curs.12", "MCX", "Pas de cursos", "MH.",
        "Codi (Conv) - Qual", "codi (conv) - qual.3", "Codi (Conv) - Qual x",
    ]
    header = F.element_at(F.array(*[F.lit(v) for v in variants]), (n + 1).cast("int"))
    return D.table(spark, folder, "part").select("p_partkey", header.alias("header"))


_PART_HEADERS_SQL = """WITH h AS (SELECT p_partkey, (['MC', 'MC.1', 'h', 'Pas de curs.12', 'MCX',
 'Pas de cursos', 'MH.', 'Codi (Conv) - Qual', 'codi (conv) - qual.3', 'Codi (Conv) - Qual x'])
 [CAST(p_partkey % 10 + 1 AS INTEGER)] AS header FROM part)"""


@query(f"""{_PART_HEADERS_SQL} SELECT * FROM h
WHERE NOT regexp_full_match(header, '(?i)(MC|H|Pas de curs|MH)([.][0-9]+)?')""")
def drop_cols(spark: SparkSession, folder: str) -> DataFrame:
    """Cells outside the irrelevant columns."""
    return tables.drop_columns(_part_headers(spark, folder))


@query(f"""{_PART_HEADERS_SQL} SELECT * FROM h
WHERE regexp_full_match(header, '(?i)Codi [(]Conv[)] - Qual([.][0-9]+)?')""")
def code_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the code columns."""
    return tables.select_columns(_part_headers(spark, folder))


@query("""WITH h AS (SELECT p_brand AS file_id, p_name AS header, min({'p': p_size, 'c': p_partkey}) AS seen
 FROM part GROUP BY ALL)
SELECT file_id, header AS name_header FROM h WHERE contains(lower(header), 'plate')
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seen) = 1""")
def name_column(spark: SparkSession, folder: str) -> DataFrame:
    """First column, in column order, whose header holds a keyword."""
    cells = D.table(spark, folder, "part").select(
        F.col("p_brand").alias("file_id"), F.col("p_name").alias("header"),
        F.col("p_size").alias("page_no"), F.col("p_partkey").alias("col_no"),
    )
    heads = tables.file_headers(cells, "PLATE").filter(F.col("name_header").isNotNull())
    return heads.select("file_id", "name_header")


@query("""SELECT o_orderkey, o_totalprice, NULL AS o_orderstatus FROM orders
UNION ALL BY NAME SELECT o_orderkey, o_orderstatus FROM orders""")
def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Page tables with different columns, stacked by column name."""
    orders = D.table(spark, folder, "orders")
    return tables.union_pages(
        orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_orderstatus")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, column_header, entry FROM (
 SELECT l_orderkey, l_linenumber, l_partkey, 'Codi (Conv) - Qual' AS column_header,
        CASE WHEN CAST(l_quantity AS INTEGER) % 10 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS entry
 FROM lineitem
 UNION ALL
 SELECT l_orderkey, l_linenumber, l_partkey, 'Codi (Conv) - Qual.1', l_returnflag FROM lineitem)
WHERE entry IS NOT NULL""")
def melt(spark: SparkSession, folder: str) -> DataFrame:
    """Code columns of a wide table to long form; null entries drop out."""
    whole = F.col("l_quantity").cast("int")
    wide = D.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(whole % 10 != 0, whole.cast("string")).alias("Codi (Conv) - Qual"),
        F.col("l_returnflag").alias("Codi (Conv) - Qual.1"),
        F.col("l_linestatus").alias("Altres"),
    )
    return tables.melt_columns(wide, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown_group'
  ELSE replace(c_mktsegment || ' grup ' || CAST(c_nationkey AS VARCHAR), ' ', '_') END AS group_code,
 CASE WHEN c_custkey % 5 = 0 THEN 'unknown_group'
  ELSE replace(c_mktsegment || ' grup ' || CAST(c_nationkey AS VARCHAR), ' ', '_') END || '.xlsx' AS output_name
FROM customer""")
def group_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Group code of each report from its first page, and the output named after it."""
    customers = D.table(spark, folder, "customer")
    group = F.concat_ws(" ", "c_mktsegment", F.lit("grup"), F.col("c_nationkey").cast("string"))
    text = F.when(
        F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("\nno code\nX Codi del grup"))
    ).otherwise(
        F.concat("c_name", F.lit("\nX Codi del grup:\n  "), group, F.lit(" \nCodi del grup\nother"))
    )
    code = group_code(text)
    return customers.select(
        "c_custkey", code.alias("group_code"), F.concat(code, F.lit(".xlsx")).alias("output_name")
    )


# --- records ---------------------------------------------------------------------------

@query(f"""WITH {D.GRADES_SQL} SELECT file_id, student, code, rtrim(code || ' (1) - ' || grade_raw) AS entry
FROM grades""")
def clean_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries torn apart by the page layout, put together again."""
    rows = D.grades(spark, folder)
    torn = F.concat(
        F.lit("  "), F.regexp_replace("code", "(RA|EM)$", "  \n $1"),
        F.lit(" \t(1)  - "), "grade_raw", F.lit("\n"),
    )
    return rows.select("file_id", "student", "code", clean_entry(torn).alias("entry"))


@query(f"""WITH {D.GRADES_SQL} SELECT file_id, student, code,
 coalesce(CAST(CAST(grade_num AS INTEGER) AS VARCHAR), grade_text) AS shown,
 CASE WHEN grade_text = 'NA' THEN '' ELSE coalesce(CAST(CAST(grade_num AS INTEGER) AS VARCHAR), grade_text) END AS cell,
 CASE WHEN grade_num IS NOT NULL THEN grade_num < 5 ELSE grade_text IN ('PDT', 'EP', 'NA', 'PQ') END AS pending
FROM records""")
def grade_values(spark: SparkSession, folder: str) -> DataFrame:
    """Each grade as shown, as a sheet cell, and whether it is pending."""
    num, text = F.col("grade_num"), F.col("grade_text")
    return D.grade_records(spark, folder).select(
        "file_id", "student", "code", G.display(num, text).alias("shown"),
        G.sheet_text(num, text).alias("cell"), G.is_pending(num, text).alias("pending"),
    )


@query(f"""WITH {D.GRADES_SQL} SELECT code, count(*) AS n_records,
 CASE WHEN code LIKE '%RA' THEN 'RA' WHEN code LIKE '%EM' THEN 'EM' ELSE 'MP' END AS column_kind,
 CASE WHEN code LIKE '%RA' OR code LIKE '%EM' THEN code ELSE split_part(code, '_', 1) END AS renamed,
 split_part(code, '_', 1) AS mp,
 list_extract(string_split(code, '_'), -1) AS outcome,
 CASE WHEN regexp_matches(list_extract(string_split(code, '_'), -1), '[0-9]')
  THEN 'RA' || CAST(CAST(regexp_replace(list_extract(string_split(code, '_'), -1), '[^0-9]', '', 'g') AS INTEGER) AS VARCHAR)
  ELSE list_extract(string_split(code, '_'), -1) END AS label,
 regexp_replace(code, '^([^_]*_[^_]*_)(.*)$', '\\1' || chr(10) || '\\2') AS two_lines, code AS one_line
FROM records GROUP BY code""")
def code_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Column kinds, names and labels derived from the codes in use."""
    code = F.col("code")
    codes = D.grade_records(spark, folder).groupBy("code").agg(F.count(F.lit(1)).alias("n_records"))
    return codes.select(
        "code", "n_records", G.column_kind(code).alias("column_kind"),
        G.renamed_header(code).alias("renamed"), G.module_of(code).alias("mp"),
        G.outcome_of(code).alias("outcome"), G.outcome_label(G.outcome_of(code)).alias("label"),
        G.two_line_header(code).alias("two_lines"),
        G.one_line_header(G.two_line_header(code)).alias("one_line"),
    )


_MODULES_SQL = f"""WITH {D.GRADES_SQL},
mods AS (SELECT DISTINCT file_id, split_part(code, '_', 1) AS mp FROM records WHERE kind = 'RA'),
type_a AS (SELECT DISTINCT r.file_id, m.mp FROM records r JOIN mods m
 ON m.file_id = r.file_id AND m.mp = split_part(r.code, '_', 1) WHERE r.kind = 'EM')"""


@query(f"{_MODULES_SQL} SELECT file_id, mp FROM mods")
def mp_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Modules of each report."""
    return rec.modules(D.grade_records(spark, folder))


@query(f"{_MODULES_SQL} SELECT file_id, mp FROM type_a")
def mp_with_em(spark: SparkSession, folder: str) -> DataFrame:
    """Modules with company placement, found in the entry text."""
    entries = D.grade_lines(spark, folder).withColumnRenamed("line", "entry")
    return rec.modules_with_em(entries, rec.modules(D.grade_records(spark, folder)))


@query(f"""{_MODULES_SQL} SELECT m.file_id, m.mp, a.mp IS NOT NULL AS type_a
FROM mods m LEFT JOIN type_a a ON a.file_id = m.file_id AND a.mp = m.mp""")
def module_types(spark: SparkSession, folder: str) -> DataFrame:
    """Type A (with placement) or type B, per report and module."""
    records = D.grade_records(spark, folder)
    type_a = rec.placement_modules(records).withColumn("type_a", F.lit(True))
    return rec.modules(records).join(type_a, ["file_id", "mp"], "left").na.fill(False, ["type_a"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY ALL HAVING count(*) > 1""")
def dup_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that occur more than once."""
    items = D.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return rec.split_duplicates(items, ["l_orderkey", "l_linenumber"])[1]


@query("""SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem
GROUP BY ALL HAVING count(*) = 1""")
def dup_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key occurs once."""
    items = D.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return rec.split_duplicates(items, ["l_orderkey", "l_linenumber"])[0]


@query(f"""WITH {D.GRADES_SQL} SELECT file_id, kind, count(*) AS n FROM records GROUP BY ALL""")
def union_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """RA, EM and MP records put together."""
    records = D.grade_records(spark, folder)
    parts = [records.filter(F.col("kind") == k) for k in G.PATTERNS]
    return rec.union_records(*parts).groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {D.GRADES_SQL} SELECT file_id, student, code,
 row_number() OVER (PARTITION BY file_id ORDER BY {SQL_KEY.format('student')}, lower(code)) AS place
FROM records""")
def sorted_records(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each record in the name and code order of its report."""
    records = rec.tidy_names(D.grade_records(spark, folder)).select(
        "file_id", "student", "code", "pos"
    )
    return ordered.with_row_number(records, ["file_id"], rec.record_order(), "place").drop("pos")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return D.table(spark, folder, "documents").select(
        F.col("lang").alias("file_id"), "source", "doc_id",
        F.posexplode(F.split("text", r"[^\p{L}]+")).alias("nth", "student"),
    ).filter(F.col("student") != "")


_TOKENS_SQL = r"""tokens AS (
 SELECT lang AS file_id, source, doc_id, unnest(parts) AS student, generate_subscripts(parts, 1) AS nth
 FROM (SELECT lang, source, doc_id, string_split_regex(text, '[^\p{L}]+') AS parts FROM documents))"""


@query(f"""WITH {_TOKENS_SQL}, firsts AS (
 SELECT file_id, student, min({{'c': lower(source), 'd': doc_id, 'n': nth}}) AS first
 FROM tokens WHERE student <> '' GROUP BY ALL)
SELECT file_id, student, row_number() OVER (PARTITION BY file_id
 ORDER BY {SQL_KEY.format('student')}, first) AS row_no FROM firsts""")
def students_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Spanish name order with accents: every word of the documents, per language."""
    records = _tokens(spark, folder).select(
        "file_id", "student", F.col("source").alias("code"),
        F.struct("doc_id", "nth").alias("pos"),
    )
    return rec.student_order(records)


@query(f"""WITH {_TOKENS_SQL} SELECT student, {SQL_KEY.format('student')} AS sort_key, count(*) AS n
FROM tokens WHERE student <> '' GROUP BY ALL""")
def spanish_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Sort key of every word of the documents."""
    words = _tokens(spark, folder).groupBy("student").agg(F.count(F.lit(1)).alias("n"))
    return words.select("student", spanish_key(F.col("student")).alias("sort_key"), "n")


# Every code the derived grades can hold: six modules with seven outcomes and a module grade.
_PIVOT_CODES = [
    code for mp in range(6) for stem in [f"0{647 + mp}_CF0{mp % 3}"]
    for code in [f"{stem}_0{n}{'EM' if n == 7 and mp % 2 == 0 else 'RA'}" for n in range(1, 8)] + [stem]
]


@query(f"WITH {D.GRADES_SQL} SELECT file_id, student, " + ", ".join(
    f"""coalesce(max(CASE WHEN code = '{c}' THEN coalesce(CAST(CAST(grade_num AS INTEGER) AS VARCHAR), grade_text) END), '') AS "{c}\""""
    for c in _PIVOT_CODES
) + " FROM records GROUP BY file_id, student")
def wide_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Student by code table of all modules."""
    return rec.wide_grades(D.grade_records(spark, folder), _PIVOT_CODES, ["file_id", "student"])


# --- sheets and review -----------------------------------------------------------------

_SHEET_SQL = f"""{_MODULES_SQL},
cols AS (
 SELECT DISTINCT file_id, split_part(code, '_', 1) AS mp, 0 AS slot, code AS header, code AS source_code
 FROM records WHERE kind = 'RA'
 UNION ALL SELECT file_id, mp, 1, mp || ' CENTRE', NULL FROM type_a
 UNION ALL SELECT a.file_id, a.mp, 2, a.mp || ' EMPRESA', max(r.code) FROM type_a a
  JOIN records r ON r.file_id = a.file_id AND r.kind = 'EM' AND split_part(r.code, '_', 1) = a.mp GROUP BY a.file_id, a.mp
 UNION ALL SELECT m.file_id, m.mp, 3, m.mp, max(r.code) FROM mods m
  LEFT JOIN records r ON r.file_id = m.file_id AND r.kind = 'MP' AND split_part(r.code, '_', 1) = m.mp GROUP BY m.file_id, m.mp),
layout AS (
 SELECT *, CAST(2 + row_number() OVER (PARTITION BY file_id ORDER BY mp, slot, header) AS INTEGER) AS col_pos FROM cols),
students AS (
 SELECT file_id, student, row_number() OVER (PARTITION BY file_id ORDER BY {SQL_KEY.format('student')}) AS row_no
 FROM (SELECT DISTINCT file_id, student FROM records)),
sheet AS (
 SELECT s.file_id, s.row_no, s.student, l.col_pos, l.mp, l.slot, l.header, r.grade_num,
  CASE WHEN r.grade_num IS NULL THEN CASE WHEN r.grade_text = 'NA' THEN '' ELSE coalesce(r.grade_text, '') END END AS grade_text
 FROM students s JOIN layout l ON l.file_id = s.file_id
 LEFT JOIN records r ON r.file_id = s.file_id AND r.student = s.student AND r.code = l.source_code),
edited AS (
 SELECT file_id, row_no, student, header,
  CASE WHEN slot = 1 THEN CAST(row_no * 7 % 110 AS DOUBLE) / 10 ELSE grade_num END AS grade_num,
  CASE WHEN slot = 1 THEN NULL ELSE grade_text END AS grade_text, mp, slot FROM sheet)"""


@query(f"{_SHEET_SQL} SELECT file_id, mp, slot, header, source_code, col_pos FROM layout")
def sheet_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the detailed sheet of each report."""
    return layout.sheet_layout(D.grade_records(spark, folder))


@query(f"""{_SHEET_SQL} SELECT file_id, row_no, student, col_pos, mp, slot, header, grade_num, grade_text,
 coalesce(CAST(CAST(grade_num AS INTEGER) AS VARCHAR), grade_text) AS value FROM sheet""")
def sheet_long(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell of the detailed sheets."""
    return layout.sheet_cells(reports.detailed_sheet(D.grade_records(spark, folder)))


@query(f"""{_SHEET_SQL} SELECT file_id, header,
 CASE WHEN grade_num IS NULL AND regexp_matches(upper(grade_text), 'PDT|EP|PQ') THEN 'marker'
  WHEN grade_num IS NULL THEN 'invalid' WHEN grade_num < 5 THEN 'failing' ELSE 'ok' END AS status,
 count(*) AS n FROM sheet GROUP BY ALL""")
def review_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many cells of each sheet column need which kind of review."""
    cells = layout.sheet_cells(reports.detailed_sheet(D.grade_records(spark, folder)))
    status = G.review_status(F.col("grade_num"), F.col("grade_text"))
    return cells.groupBy("file_id", "header", status.alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _edited_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Detailed sheets in which staff filled the CENTRE columns."""
    mark = (F.col("row_no") * 7 % 110).cast("double") / 10

    def fill(cell):
        centre = cell["slot"] == layout.CENTRE
        return cell.withField(
            "grade_num", F.when(centre, mark).otherwise(cell["grade_num"])
        ).withField("grade_text", F.when(~centre, cell["grade_text"]))

    rows = reports.detailed_sheet(D.grade_records(spark, folder))
    return rows.withColumn("cells", F.transform("cells", fill))


_FINAL_SQL = f"""{_SHEET_SQL}, final AS (
 SELECT file_id, row_no, student, mp, header, slot = 1 AS type_a, grade_num, grade_text,
  CASE WHEN grade_num IS NULL THEN grade_text WHEN slot = 1 THEN printf('%.2f', grade_num)
   ELSE CAST(CAST(grade_num AS INTEGER) AS VARCHAR) END AS shown,
  CASE WHEN grade_num IS NULL AND upper(grade_text) IN ('PDT', 'EP', 'PQ') THEN 'marker'
   WHEN grade_num IS NULL THEN 'invalid'
   WHEN grade_num < (CASE WHEN slot = 1 THEN 4.5 ELSE 5 END) THEN 'failing' ELSE 'ok' END AS status,
  CASE WHEN grade_num IS NULL THEN grade_text <> ''
   WHEN slot = 1 THEN grade_num NOT BETWEEN 0 AND 9 ELSE grade_num NOT BETWEEN 0 AND 10 END AS out_of_range
 FROM edited e WHERE slot = 1 OR (slot = 3 AND NOT EXISTS (
  SELECT 1 FROM type_a a WHERE a.file_id = e.file_id AND a.mp = e.mp)))"""


@query(f"{_FINAL_SQL} SELECT * FROM final")
def final_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Final column of each module with display, status and range check."""
    return reports.final_grade_summary(_edited_rows(spark, folder))


@query(f"{_FINAL_SQL} SELECT CAST(file_id AS VARCHAR) AS file_id, * EXCLUDE (file_id) FROM final")
def edited_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets written with a legend below an empty row, read back and summarised."""
    cells = layout.sheet_cells(_edited_rows(spark, folder))
    below = cells.groupBy("file_id").agg(F.max("row_no").alias("last")).select(
        "file_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "last"
    ).select(
        "file_id", (F.col("last") + F.col("n")).alias("row_no"),
        F.when(F.col("n") == 2, "Llegenda").alias("student"),
        F.lit("0000").alias("mp"), F.lit(layout.MODULE).alias("slot"), F.lit("0000").alias("header"),
    )
    path = f"{shared_folder(spark)}/sheets-{uuid4().hex}"
    write_sheets(cells.unionByName(below, allowMissingColumns=True), path)
    return reports.edited_sheet_summary(read_sheets(spark, path))


@query(f"{_FINAL_SQL} SELECT file_id, header, status, count(*) AS n FROM final GROUP BY ALL")
def summary_status(spark: SparkSession, folder: str) -> DataFrame:
    """Review status of the final columns, counted; from sheets in long form."""
    final = summary.final_summary(layout.sheet_cells(_edited_rows(spark, folder)))
    return final.groupBy("file_id", "header", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_FINAL_SQL} SELECT file_id, row_no, student, header, grade_num, grade_text
FROM final WHERE out_of_range""")
def range_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Final grades outside the accepted range."""
    final = reports.final_grade_summary(_edited_rows(spark, folder))
    return final.filter("out_of_range").select(
        "file_id", "row_no", "student", "header", "grade_num", "grade_text"
    )


@query("""WITH c AS (SELECT o_custkey AS sheet_id, o_orderkey AS row_no,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS value FROM orders)
SELECT * FROM c WHERE row_no < coalesce((SELECT min(e.row_no) FROM c e
 WHERE e.sheet_id = c.sheet_id AND e.value IS NULL), 9223372036854775807)""")
def cut_blank_row(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet rows above the first fully empty one."""
    cells = D.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("sheet_id"), F.col("o_orderkey").alias("row_no"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("value"),
    )
    return summary.cut_at_blank_row(cells, "sheet_id", "row_no", "value")


@query(f"""WITH {D.GRADES_SQL}, names AS ({CATALOG_VALUES})
SELECT mp, mp || coalesce('. ' || n.mp_name, '') AS mp_label, n_records FROM (
 SELECT split_part(code, '_', 1) AS mp, count(*) AS n_records FROM records GROUP BY 1)
LEFT JOIN names n ON n.mp_code = mp""")
def catalog_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Records per module, with the module's catalogue name."""
    counts = D.grade_records(spark, folder).groupBy(G.module_of(F.col("code")).alias("mp")).agg(
        F.count(F.lit(1)).alias("n_records")
    )
    return with_module_label(counts, bundled_names(spark))


@query("""SELECT c_name AS estudiant, n AS code_no, CASE WHEN (i + n) % 6 = 0
  THEN (['PDT', 'EP', '', 'PQ'])[CAST((i + n) % 4 + 1 AS INTEGER)] END AS grade_text,
 CASE WHEN (i + n) % 6 <> 0 THEN CAST(([7, 8, 4, 9, 6])[CAST((i + n) % 5 + 1 AS INTEGER)] AS DOUBLE) END AS grade_num
FROM (SELECT c_name, c_custkey AS i FROM customer), (SELECT DISTINCT l_linenumber AS n FROM lineitem)""")
def synthetic_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Repeatable benchmark grades: one student per customer, one code per line number."""
    numbers = D.table(spark, folder, "lineitem").agg(
        F.sort_array(F.collect_set("l_linenumber")).alias("codes")
    ).scalar()
    students = D.table(spark, folder, "customer").select(
        F.col("c_name").alias("estudiant"), F.col("c_custkey").alias("i")
    )
    return synthetic.synthetic_grades(students, "i", numbers).drop("i")
