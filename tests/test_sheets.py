import json

from pyspark.sql import functions as F

from gradeloom.functions import grades as G
from gradeloom.operators import layout, pending, records as rec, summary
from gradeloom.plans import reports
from gradeloom.sources.catalog import bundled_names, first_names, parse_catalog, with_module_label

RECORD = (
    "file_id string, student string, code string, kind string, grade_num double, "
    "grade_text string, pos long"
)
CASE = {
    "Ferrer Puig, Oriol": {"0901_VV02_01RA": 6, "0901_VV02_02RA": "EP", "0901_VV02_03EM": 9.5,
                           "0901_VV02": 7, "0944_VV03_01RA": "NA", "0944_VV03": 3},
    "Zamora Gil, Núria": {"0901_VV02_01RA": 8, "0901_VV02_02RA": 5, "0901_VV02_03EM": 5.75,
                          "0901_VV02": 9, "0944_VV03_01RA": 10, "0944_VV03": 10},
}


CASE_NAMES = list(CASE)


def make(spark, case, file_id="f"):
    data = []
    for student, grades in case.items():
        for code, g in grades.items():
            kind = "RA" if code.endswith("RA") else "EM" if code.endswith("EM") else "MP"
            text = isinstance(g, str)
            data.append((file_id, student, code, kind, None if text else float(g), g if text else None, len(data)))
    return spark.createDataFrame(data, RECORD)


def test_detailed_sheet(spark):
    rows = reports.detailed_sheet(make(spark, CASE))
    cells = layout.sheet_cells(rows).orderBy("row_no", "col_pos").collect()
    heads = ["0901_VV02_01RA", "0901_VV02_02RA", "0901 CENTRE", "0901 EMPRESA", "0901", "0944_VV03_01RA", "0944"]
    for row_no in (1, 2):
        assert [(c.col_pos, c.header) for c in cells if c.row_no == row_no] == list(enumerate(heads, 3))
    shown = {(c.student[:6], c.header): c.value for c in cells}
    assert [shown["Ferrer", h] for h in heads] == ["6", "EP", "", "9.5", "7", "", "3"]
    assert [shown["Zamora", h] for h in heads] == ["8", "5", "", "5.75", "9", "10", "10"]


def test_modules_without_outcomes_leave_the_sheet_and_last_placement_wins(spark, rows):
    case = {
        "Ana": {"MP01_CF01_1RA": 5, "MP01_CF01_1EM": 6, "MP03_CF01": 9, "MP03_CF01_1EM": 9},
        "Bea": {"MP01_CF01_2EM": 7},
    }
    cells = layout.sheet_cells(reports.detailed_sheet(make(spark, case)))
    got = rows(cells.filter("header like '%EMPRESA'"), "student", "header", "value")
    assert got == [("Ana", "MP01 EMPRESA", ""), ("Bea", "MP01 EMPRESA", "7")]
    assert rows(cells.filter("mp = 'MP03'")) == []


def test_reports_with_duplicates_are_left_out_others_stay(spark, rows):
    twice = make(spark, {"Ana": {"MP01_CF01_1RA": 5}}, "bad")
    records = twice.unionByName(twice).unionByName(make(spark, CASE, "good"))
    sheet = reports.detailed_sheet(records)
    assert rows(sheet.select("file_id").distinct()) == [("good",)]


def test_a_lower_case_placement_code_needs_a_capital_one_nearby(spark, rows):
    records = make(spark, {"Ona": {"0647_CF01_01RA": 7, "0647_CF01_07em": 8, "0647_CF01": 6}}).withColumn(
        "kind", F.when(F.col("code").endswith("em"), "EM").otherwise(F.col("kind"))
    )
    cells = layout.sheet_cells(reports.detailed_sheet(records))
    assert rows(cells, "header") == [("0647",), ("0647_CF01_01RA",)]
    assert rows(layout.module_conflicts(records), "mp", "n_codes") == [("0647", 2)]
    capital = records.withColumn("capital_em", F.lit(True))
    assert rows(rec.placement_modules(capital), "mp") == [("0647",)]


def test_colliding_module_codes_are_reported(spark, rows):
    case = {"Ana": {"MP01_CF01_1RA": 5, "MP01_CF01": 6, "MP01_CF02": 7}}
    assert rows(layout.module_conflicts(make(spark, case)), "mp", "n_codes") == [("MP01", 2)]


def test_pending_texts(spark, rows):
    got = rows(reports.pending_summary(make(spark, CASE)), "row_no", "student", "pending")
    assert got == [(1, "Ferrer Puig, Oriol", "0901:\n- RA2\n\n0944:\n- RA1"), (2, "Zamora Gil, Núria", "")]


def test_pending_uses_catalogue_names_and_numeric_order(spark, rows):
    case = {
        "A": {"0647_CF01_1RA": "PDT", "0647_CF01_2RA": 7},
        "B": {"MP01_CF01_7RA": 7, "MP01_CF01_10RA": "PDT", "MP01_CF01_9RA": "PDT", "MP01_CF01_2RA": "PDT"},
    }
    got = dict(rows(reports.pending_summary(make(spark, case)), "student", "pending"))
    assert got["A"] == "0647. Gestió de la documentació jurídica i empresarial:\n- RA1"
    assert got["B"] == "MP01:\n- RA2\n- RA9\n- RA10"


def test_pending_rule(spark):
    cases = [
        (None, None, False), (4.9, None, True), (5.0, None, False), (None, " pdt ", True), (None, "NA", True),
        (None, "", False), (None, "  ", False), (None, "4.5", True), (None, "7", False), (None, "7d", True),
        (None, "nan", False), (None, "inf", False), (None, "-inf", True), (None, "other", True),
        (None, "+5.", False), (None, "1e0", True), (float("nan"), None, False),
    ]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "i int, n double, t string, want boolean")
    bad = df.filter(~G.is_pending(F.col("n"), F.col("t")).eqNullSafe(F.col("want"))).collect()
    assert bad == []


def test_catalogue_first_programme_wins(spark, rows):
    text = json.dumps({
        "P1": [{"codi": "A", "nom": "first"}, {"codi": None, "nom": "x"}, {"codi": "B", "nom": ""}],
        "P2": [{"codi": "A", "nom": "second"}, {"codi": "B", "nom": "b"}],
    })
    catalog = parse_catalog(spark.createDataFrame([(text,)], "text string"))
    assert catalog.count() == 5
    assert rows(first_names(catalog)) == [("A", "first"), ("B", "b")]
    assert bundled_names(spark).count() == 32
    labels = with_module_label(spark.createDataFrame([("A",), ("Z",)], "mp string"), first_names(catalog))
    assert rows(labels, "mp_label") == [("A. first",), ("Z",)]


def test_labels_and_headers(spark):
    df = spark.createDataFrame([("0647_CF01_02RA",), ("plain",), ("MP01_x",)], "c string")
    c = F.col("c")
    got = df.select(
        G.column_kind(c), G.renamed_header(c), G.outcome_label(G.outcome_of(c)), G.two_line_header(c),
        G.one_line_header(G.two_line_header(c)),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("RA", "0647_CF01_02RA", "RA2", "0647_CF01_\n02RA", "0647_CF01_02RA"),
        ("MP", "plain", "plain", "plain", "plain"), ("MP", "MP01", "x", "MP01_x", "MP01_x"),
    ]


def test_review_and_range_rules(spark):
    df = spark.createDataFrame(
        [(None, "xPdTx", "M"), (None, "PDT", "M"), (None, "", "M"), (None, None, "M"), (4.5, None, "M CENTRE"),
         (4.4, None, "M CENTRE"), (9.5, None, "M CENTRE"), (4.9, None, "M"), (7.5, None, "M"), (10.0, None, "M")],
        "n double, t string, h string",
    )
    n, t, h = F.col("n"), F.col("t"), F.col("h")
    got = [tuple(r) for r in df.select(
        G.review_status(n, t), G.summary_status(n, t, h), G.in_range(n, t, h), G.rounded_display(n, t, h)
    ).collect()]
    assert got == [
        ("marker", "invalid", False, "xPdTx"), ("marker", "marker", False, "PDT"),
        ("invalid", "invalid", True, ""), ("invalid", "invalid", True, ""),
        ("failing", "ok", True, "4.50"), ("failing", "failing", True, "4.40"), ("ok", "ok", False, "9.50"),
        ("failing", "failing", False, "5"), ("ok", "ok", False, "8"), ("ok", "ok", True, "10"),
    ]


def test_summary_keeps_final_columns(spark, rows):
    final = reports.final_grade_summary(reports.detailed_sheet(make(spark, CASE)))
    got = rows(final, "student", "header", "type_a", "shown", "status")
    assert got == [
        (CASE_NAMES[0], "0901 CENTRE", True, "", "invalid"), (CASE_NAMES[0], "0944", False, "3", "failing"),
        (CASE_NAMES[1], "0901 CENTRE", True, "", "invalid"), (CASE_NAMES[1], "0944", False, "10", "ok"),
    ]


def test_sheet_ends_at_the_first_empty_row(spark, rows):
    data = [("s", 1, "a"), ("s", 2, None), ("s", 2, None), ("s", 3, "legend"), ("t", 1, None), ("t", 1, "b")]
    df = spark.createDataFrame(data, "sheet string, row int, value string")
    got = rows(summary.cut_at_blank_row(df, "sheet", "row", "value"))
    assert got == sorted([("s", 1, "a"), ("t", 1, None), ("t", 1, "b")], key=repr)


def test_literal_na_is_blank_in_the_sheet_but_pending(spark, rows):
    records = make(spark, {"NA": {"MP01_CF01_1RA": "NA"}})
    cell = layout.sheet_cells(reports.detailed_sheet(records)).filter("slot = 0").first()
    assert (cell.student, cell.value) == ("", "")
    assert pending.pending_outcomes(records).count() == 1
    assert rec.student_order(records).first().student == "NA"


def test_cells_of_a_row_are_built_once(spark):
    rows = spark.range(2).select(
        F.lit(1).alias("file_id"), F.col("id").alias("row_no"), F.lit("Ann").alias("student"),
        F.transform(F.sequence(F.lit(1), F.col("id") + 1), lambda n: F.struct(
            n.cast("int").alias("col_pos"), F.lit("0647").alias("mp"), F.lit(layout.MODULE).alias("slot"),
            F.lit("0647").alias("header"), n.cast("double").alias("grade_num"), F.lit(None).cast("string").alias("grade_text"),
        )).alias("cells"),
    )
    cells = layout.sheet_cells(rows)
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 1
    assert sorted((r.row_no, r.col_pos) for r in cells.collect()) == [(0, 1), (1, 1), (1, 2)]
