import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.text import clean_entry
from gradeloom.operators import ordered, records, tables
from gradeloom.plans import reports
from gradeloom.schemas import RAW_CELLS
from gradeloom.sources import derived

HEADS = ["Núm.", "Identificador", "Nom\ni cognoms ", " Codi (Conv)\n- Qual "]


def raw(spark, pages):
    """``{(file, page): [header row, rows...]}`` to raw cells."""
    return spark.createDataFrame(
        [
            (f, p, r, c, cell)
            for (f, p), lines in pages.items()
            for r, line in enumerate(lines)
            for c, cell in enumerate(line)
        ],
        RAW_CELLS,
    )


def test_headers_become_one_line(spark, rows):
    df = spark.createDataFrame([("Nom\ni cognoms ",), (" Codi (Conv)\n- Qual ",)], "header string")
    assert rows(tables.normalize_headers(df)) == [("Codi (Conv) - Qual",), ("Nom i cognoms",)]


def test_irrelevant_headers_and_their_copies_are_dropped(spark, rows):
    names = ["Nom", "MC", "MC.1", "Pas de curs", "Qualificació", None, "MC.x"]
    df = spark.createDataFrame([(n,) for n in names], "header string")
    got = rows(tables.drop_columns(df, ["MC", "Pas de curs"]))
    assert got == sorted([("Nom",), ("Qualificació",), (None,), ("MC.x",)], key=repr)


def test_blank_names_are_filled_and_texts_joined(spark, rows):
    cells = raw(spark, {("f", 0): [
        HEADS, ["1", "a", "Ona", "E1"], ["", "", "", " E2 "], ["2", "b", "Roc", "E3"],
    ]})
    got = reports.merged_rows(cells).filter("header like 'Codi%'")
    assert rows(got, "student", "entry") == [("Ona", "E1\nE2"), ("Roc", "E3")]


def test_a_name_split_over_a_page_break_is_glued(spark, rows):
    cells = raw(spark, {
        ("f", 0): [HEADS, ["7", "ID-40", "Pla i Torrent, Maria", "0901_VV02 (2) - 6"]],
        ("f", 1): [HEADS, ["", "", "del Mar", "0944_VV03 (1) - 10"],
                   ["8", "ID-41", "Quer Bosch, Pau", "0901_VV02 (1) - 5"]],
    })
    got = {(s, h): e for s, h, e in rows(reports.merged_rows(cells), "student", "header", "entry")}
    assert got == {
        ("Pla i Torrent, Maria del Mar", "Núm."): "7",
        ("Pla i Torrent, Maria del Mar", "Identificador"): "ID-40",
        ("Pla i Torrent, Maria del Mar", "Codi (Conv) - Qual"): "0901_VV02 (2) - 6\n0944_VV03 (1) - 10",
        ("Quer Bosch, Pau", "Núm."): "8",
        ("Quer Bosch, Pau", "Identificador"): "ID-41",
        ("Quer Bosch, Pau", "Codi (Conv) - Qual"): "0901_VV02 (1) - 5",
    }


def test_pages_may_have_other_columns(spark, rows):
    cells = raw(spark, {
        ("f", 0): [["Nom i cognoms", "Codi (Conv) - Qual", "MH"], ["Ana", "E1", "x"]],
        ("f", 1): [["Extra", "Nom i cognoms"], ["n1", "Bea"]],
    })
    got = rows(reports.merged_rows(cells), "student", "header", "entry")
    assert got == [("Ana", "Codi (Conv) - Qual", "E1"), ("Bea", "Extra", "n1")]


def test_columns_with_one_header_stay_apart_in_any_order(spark, rows):
    heads = ["Nom i cognoms", "Codi (Conv) - Qual", "Codi (Conv) - Qual"]
    cells = raw(spark, {
        ("f", 0): [heads, ["Ona", "0901_VV02_02RA (1) -", "0901_VV02_03RA (1) - A5"], ["", "A7", "0901_VV02_04RA (1) - A6"]],
        ("f", 1): [heads, ["Pau", "0901_VV02_02RA (1) - A8", "0901_VV02_03RA (1) - A9"]],
    })
    want = [("Ona", "0901_VV02_02RA", 7.0, 2), ("Ona", "0901_VV02_03RA", 5.0, 3), ("Ona", "0901_VV02_04RA", 6.0, 3),
            ("Pau", "0901_VV02_02RA", 8.0, 2), ("Pau", "0901_VV02_03RA", 9.0, 3)]
    for order in (F.col("col_no"), F.col("col_no").desc()):
        found = reports.extract_records(cells.orderBy(order))
        assert rows(found.select("student", "code", "grade_num", "pos.col_no")) == want


def test_without_leading_columns_names_are_glued_only_on_request(spark, rows):
    cells = raw(spark, {("f", 0): [["Nom i cognoms", "X"], ["Ana", "1"], ["Bea", "2"]]})
    assert rows(tables.student_rows(cells), "student") == [("Ana",), ("Bea",)]
    strict = tables.student_rows(cells, strict_reference=True)
    assert rows(strict, "student") == [("Ana Bea",), ("Ana Bea",)]


def test_namesakes_merge_and_rows_before_the_first_name_drop(spark, rows):
    cells = raw(spark, {("f", 0): [
        HEADS, ["1", "a", "", "lost"], ["2", "b", "Ana", "E1"], ["3", "c", "Bea", "E2"],
        ["4", "d", "Ana", "E3"],
    ]})
    got = reports.merged_rows(cells).filter("header like 'Codi%'")
    assert rows(got, "student", "entry") == [("Ana", "E1\nE3"), ("Bea", "E2")]


def _walk(names, leading):
    """One pass over the rows, changing names as it goes."""
    out = list(names)
    for i in range(1, len(out)):
        if out[i] is not None and leading[i] and out[i - 1] is not None:
            out[i - 1] = f"{out[i - 1].strip()} {out[i].strip()}"
            out[i] = None
    return out


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_gluing_equals_a_sequential_walk(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    rng = random.Random(3)
    data, want = [], []
    for f in range(60):
        n = rng.randrange(1, 14)
        names = [rng.choice([None, f"n{i}", f"m{i}"]) for i in range(n)]
        leading = [rng.random() < 0.7 for _ in range(n)]
        data += [(f, i, names[i] or " ", leading[i]) for i in range(n)]
        last = None
        for i, name in enumerate(_walk(names, leading)):
            last = name or last
            want.append((f, i, name, last))
    df = spark.createDataFrame(data, "f int, i long, name string, lead boolean")
    glued = tables.glue_names(df, ["f"], "i", "name", F.col("lead"), "whole")
    got = tables.fill_names(glued, ["f"], "i", "whole")
    assert rows(got, "f", "i", "whole", "student") == sorted(want, key=repr)


def test_union_fills_missing_columns(spark, rows):
    one = spark.createDataFrame([(1, "a")], "n int, x string")
    two = spark.createDataFrame([(2, "b")], "n int, y string")
    assert rows(tables.union_pages(one, two)) == [(1, "a", None), (2, None, "b")]


def test_code_columns_are_melted_and_cleaned(spark, rows):
    df = spark.createDataFrame(
        [("Ona", "0944_VV03_02 RA   (3) - A6", "other")],
        "`Nom i cognoms` string, `Codi (Conv) - Qual` string, `No match` string",
    )
    long = tables.melt_columns(df, ["Nom i cognoms"])
    got = rows(long.select("column_header", clean_entry(F.col("entry"))))
    assert got == [("Codi (Conv) - Qual", "0944_VV03_02RA (3) - A6")]


def test_records_come_from_code_columns_of_all_reports(spark, rows):
    cells = raw(spark, {
        ("f", 0): [HEADS, ["1", "a", "Ana", "0647_CF01_01RA (1) -"], ["", "", "", "A7"]],
        ("g", 0): [HEADS, ["1", "a", "Ana", "0647_CF01 (1) - 8"]],
    })
    got = rows(reports.extract_records(cells), "file_id", "student", "code", "grade_num")
    assert got == [("f", "Ana", "0647_CF01_01RA", 7.0), ("g", "Ana", "0647_CF01", 8.0)]


def test_the_lines_of_report_pages_are_numbered_once(spark, tmp_path):
    spark.createDataFrame([(1, 7, "Ann", "B")], "c_custkey long, c_nationkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, 3, 1, 16.0), (5, 4, 2, 17.0)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = derived.raw_cells(spark, str(tmp_path))
    assert cells.count() == 6 + 4 * 6  # two outcomes and their modules below the headers
    # Header cells and the others are read apart: neither may number the lines again.
    plan = cells.filter("row_no = 0")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_entries_are_cut_at_breaks_that_follow_a_grade(spark):
    df = spark.createDataFrame(
        [("a - A7\nb - x_y\nc -  PDT\nRA (1)\nd - 12345678\ne - 123456789\n f",)], "t string"
    )
    pieces = df.select(F.split("t", records._BOUNDARY)).first()[0]
    assert pieces == ["a - A7", "b - x_y\nc -  PDT\nRA (1)\nd - 12345678", "e - 123456789\n f"]
    assert records._BOUNDARY.startswith(r"(?U)\n")  # the look behind is not tried at every character
