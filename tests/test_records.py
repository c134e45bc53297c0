import random
import re

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import grades as G
from gradeloom.functions.text import spanish_key, strip
from gradeloom.operators import records as rec

RECORD = "file_id string, student string, code string, kind string, grade_num double, grade_text string, pos long"


def _extract(spark, rows, *texts):
    df = spark.createDataFrame([("f", str(n), t) for n, t in enumerate(texts)], "file_id string, s string, entry string")
    return rows(rec.extract_records(df, ["s"]), "s", "kind", "code", "grade_num", "grade_text")


def test_grades_become_numbers_or_stay_text(spark, rows):
    got = _extract(
        spark, rows,
        "MP01_CF01_01RA (1) - A7\nMP01_CF01_02RA (1) - PDT", "MP02_CF02 (1) - 8", "MP02_CF02 (1) - A10",
        "MP01_CF01_01RA (1) - a7",
    )
    assert got == [
        ("0", "RA", "MP01_CF01_01RA", 7.0, None), ("0", "RA", "MP01_CF01_02RA", None, "PDT"),
        ("1", "MP", "MP02_CF02", 8.0, None), ("2", "MP", "MP02_CF02", 10.0, None),
        ("3", "RA", "MP01_CF01_01RA", None, "a7"),
    ]


def test_edge_entries(spark, rows):
    got = _extract(
        spark, rows,
        "MP01_CF01_1RA (1) - A7",              # one digit: not an outcome
        "MP01_CF01_01RA (1) - 8",              # bare number: no grade for RA
        "MP01_CF01_0 1RA (1) - A5",       # hard blank inside the code
        "MP01_CF01_01RA (1) - EP01_CF01_02RA (1) - A6",  # steals EP from the next code
        "MP01_CF01 (1) - A10x", "MP01_CF01 (1) - PQ", "MP01_CF01_01EM (2) - A9",
        "MP01_CF01_01 RA (1) - A4", "MP01_CF01_01RA (1) -",
    )
    assert [(s, k, c, n, t) for s, k, c, n, t in got] == [
        ("1", "RA", "MP01_CF01_01RA", None, ""),
        ("2", "RA", "MP01_CF01_01RA", 5.0, None),
        ("3", "RA", "MP01_CF01_01RA", None, "EP"),
        ("4", "MP", "MP01_CF01", None, ""), ("5", "MP", "MP01_CF01", None, "PQ"),
        ("6", "EM", "MP01_CF01_01EM", 9.0, None),
        ("7", "RA", "MP01_CF01_01RA", 4.0, None), ("8", "RA", "MP01_CF01_01RA", None, ""),
    ]


def _brute(text):
    """Grades of a whole text with Python's own regular expressions."""
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(r"([A-Za-z0-9_]+)\s+(RA|EM)(?=\s*\(\d+\))", r"\1\2", text)
    out = []
    for kind, pattern in G.PATTERNS.items():
        for code, raw in re.findall(pattern.replace("(?iU)", "(?i)"), text):
            out.append((kind, re.sub(r"\s+", "", code), raw))
    return out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pieces_hold_the_grades_of_the_whole_text(spark, rows, block):
    rng = random.Random(block)
    bits = [
        "0647_CF01_01RA (1) - A7", "0647_CF01_02RA (1) - PDT", "0648_CF01 (1) - 8", "0648_CF01 (1) -",
        "0647_CF01_03RA (1) -", "EP01_CF01_01RA (1) - A6", "A9", "RA (1) - A5", "0647_CF01_04", "- EP",
        "NA01_CF02_07EM (1) - NA", "(1) - A8", "free text", "x_y", "10", "0650_CF01_0", "5RA (1) - A5",
    ]
    data, want = [], []
    for student in range(40):
        texts = [rng.choice(bits) for _ in range(rng.randrange(1, 16))]
        data += [("f", str(student), 1, 0, i, t) for i, t in enumerate(texts)]
        want += [(str(student), *found) for found in _brute("\n".join(texts))]
    df = spark.createDataFrame(
        data, "file_id string, student string, col_no int, first_row long, row_idx long, text string"
    )
    found = rec.extract_records(rec.entry_pieces(df, block), ["student"])
    raw = F.coalesce(F.col("grade_num").cast("int").cast("string"), "grade_text")
    got = rows(found.select("student", "kind", "code", raw))
    show = lambda r: re.sub(r"^A?(?=\d+$)", "", r)
    assert got == sorted([(s, k, c, show(r)) for s, k, c, r in want], key=repr)


def _records(spark, *items):
    return spark.createDataFrame(
        [("f", s, c, k, float(g) if isinstance(g, (int, float)) else None,
          g if isinstance(g, str) else None, n) for n, (s, c, k, g) in enumerate(items)], RECORD,
    )


def test_modules_and_modules_with_placement(spark, rows):
    records = _records(spark, ("A", "MP01_CF01_1RA", "RA", 7), ("A", "MP02_CF02_1RA", "RA", 8))
    entries = spark.createDataFrame(
        [("f", "A", "MP01_CF01_12EM (1) - A8"), ("f", "B", "no EM here"),
         ("f", "C", "mp02_cf01_12em (1)"), ("f", "D", "MP09_CF01_12EM (1)")],
        "file_id string, student string, entry string",
    )
    found = rec.modules(records)
    assert rows(found, "mp") == [("MP01",), ("MP02",)]
    assert rows(rec.modules_with_em(entries, found), "mp") == [("MP01",)]
    capital = entries.unionByName(spark.createDataFrame(
        [("f", "C", "the EM part")], "file_id string, student string, entry string"))
    lower = rec.modules_with_em(capital.withColumn("entry", F.replace("entry", F.lit("mp02"), F.lit("MP02"))), found)
    assert rows(lower, "mp") == [("MP01",), ("MP02",)]


def test_students_are_in_spanish_order(spark):
    # Accents and case do not count, and an eñe comes after every other n.
    want = ["Ébano", "luz clara", "Manso", "Márquez", "Mazo", "Nubes", "Núñez", "Ñíguez", "Oller"]
    records = rec.tidy_names(_records(spark, *[(n.replace(" ", "\n"), "0901", "MP", 5) for n in reversed(want)]))
    got = [r.student for r in rec.student_order(records).orderBy("row_no").collect()]
    assert sorted(got, key=want.index) == got


def test_records_sort_by_name_then_folded_code(spark):
    records = rec.tidy_names(_records(
        spark, ("vila\nroca", "0944b", "MP", 5), ("Vila Mas", "0944C", "MP", 7), ("vila\nroca", "0944A", "MP", 6)
    ))
    got = [(r.student, r.code) for r in records.orderBy(*rec.record_order()).collect()]
    assert got == [("Vila Mas", "0944C"), ("vila roca", "0944A"), ("vila roca", "0944b")]


def test_key_equals_casefold_and_decomposition(spark, rows):
    import unicodedata

    texts = ["Ñu", "nz", "STRASSE Straße", "ÀÉÎõü", "ŒuvreǅŉΐﬁIJ", "ñ", "İstanbul", "ŁÓDŹ", "", "a-1 .,"]

    def key(text):
        folded = unicodedata.normalize("NFD", text.casefold().replace("ñ", "nz"))
        return "".join(c for c in folded if unicodedata.category(c) != "Mn")

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows(df.select("t", spanish_key(F.col("t")))) == sorted([(t, key(t)) for t in texts], key=repr)


def test_strip_takes_all_unicode_blanks(spark):
    text = "  \x1c a b \x1f\n"
    got = spark.createDataFrame([(text,)], "t string").select(strip(F.col("t"))).first()[0]
    assert got == text.strip() == "a b"


def test_duplicates_are_set_apart(spark, rows):
    records = _records(spark, ("A", "X", "RA", 7), ("A", "X", "RA", 8), ("B", "X", "RA", 5))
    clean, repeated = rec.split_duplicates(records, ["file_id", "student", "code"])
    assert rows(clean, "student") == [("B",)] and rows(repeated, "student", "copies") == [("A", 2)]
    assert rows(rec.files_without_duplicates(records)) == []


def test_wide_table_shows_numbers_texts_and_blanks(spark, rows):
    records = _records(spark, ("A", "X", "RA", 7), ("A", "Y", "RA", "PDT"), ("B", "X", "RA", 8.5), ("B", "Y", "RA", "nan"))
    got = rows(rec.wide_grades(records, ["X", "Y", "Z"], ["student"]))
    assert got == [("A", "7", "PDT", ""), ("B", "8.5", "", "")]
