"""Arriving reports: outcomes in batch and stream, replacing, and tables of newest rows."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.plans import reports
from gradeloom.schemas import MANIFEST, RAW_CELLS
from gradeloom.streaming import current
from gradeloom.streaming.ingest import ingest_reports, read_ingested

HEAD = ["Núm.", "Nom i cognoms", "Codi (Conv) - Qual"]
GOOD = [HEAD, ["1", "Ana", "0647_CF01_01RA (1) - A7"]]
PAGES = {
    "good": GOOD,
    "null": [[None, *HEAD[1:]], ["1", "Ana", "0647_CF01_01RA (1) - A7"]],
    "noname": [["Núm.", "Nom", "Codi (Conv) - Qual"], ["1", "Ana", "0647_CF01_01RA (1) - A7"]],
    "nora": [HEAD, ["1", "Ana", "0647_CF01 (1) - 7"]],
    "heads": [HEAD],
    "twice": [HEAD, ["1", "Ana", "0647_CF01_01RA (1) - A7"], ["", "", "0647_CF01_01RA (2) - A8"]],
    "empty": [],
}
REASONS = {
    "good": None, "null": "null_header", "noname": "no_name_column", "nora": "no_outcome_codes",
    "heads": "no_outcome_codes", "twice": "duplicate_grades", "empty": "no_tables",
}


def raw(spark, pages):
    return spark.createDataFrame(
        [(f, 0, r, c, v) for f, lines in pages.items() for r, line in enumerate(lines) for c, v in enumerate(line)],
        RAW_CELLS,
    )


def test_a_batch_gives_every_report_an_outcome(spark, rows):
    files = spark.createDataFrame([(f, f"{f}.pdf") for f in PAGES], "file_id string, source_name string")
    records, told = reports.convert_reports(raw(spark, PAGES), files)
    assert dict(rows(told, "file_id", "reason")) == REASONS
    assert {r.source_name for r in told.collect()} == {f"{f}.pdf" for f in PAGES}
    assert rows(records, "file_id", "code", "grade_num") == [("good", "0647_CF01_01RA", 7.0)]
    none, told = reports.convert_reports(raw(spark, {}), files.limit(0))
    assert none.count() == 0 and told.count() == 0


@pytest.fixture
def stream(spark, tmp_path):
    """Delivers arrivals and runs the ingest over what is new."""
    at = {n: f"{tmp_path}/{n}" for n in ("manifest", "cells", "out", "check")}

    def deliver(number, pages):
        raw(spark, pages).write.parquet(f"{at['cells']}/arrival={number}")
        named = [(f, number, "job", f"{f}-{number}.pdf") for f in pages]
        spark.createDataFrame(named, MANIFEST).coalesce(1).write.mode("append").parquet(at["manifest"])

    def run(**options):
        ingest_reports(spark, at["manifest"], at["cells"], at["out"], at["check"], **options)

    def read(name):
        return read_ingested(spark, at["out"], name)

    return deliver, run, read


def test_a_second_arrival_replaces_the_first(stream, rows):
    deliver, run, read = stream
    deliver(1, PAGES)
    run()
    assert dict(rows(read("outcomes"), "file_id", "reason")) == REASONS
    assert rows(read("sheets"), "file_id", "student", "value") != []
    # The good one comes empty, a bad one good with another grade; a restart sees the new file only.
    deliver(2, {"good": [], "twice": [HEAD, ["1", "Bea", "0647_CF01_01RA (1) - A9"]]})
    run(files_per_batch=1)
    found = {r.file_id: r for r in read("outcomes").collect()}
    assert {f: r.reason for f, r in found.items()} == REASONS | {"good": "no_tables", "twice": None}
    assert found["good"].source_name == "good-2.pdf" and found["null"].source_name == "null-1.pdf"
    assert rows(read("records"), "file_id", "student", "grade_num") == [("twice", "Bea", 9.0)]
    assert {r.file_id for r in read("sheets").collect()} == {"twice"}
    before = read("outcomes").count()
    run()  # nothing new
    assert read("outcomes").count() == before


def test_of_arrivals_in_one_batch_the_last_counts(stream, rows):
    deliver, run, read = stream
    deliver(2, {"f": GOOD})
    deliver(1, {"f": [HEAD]})
    run(every=1)
    assert rows(read("outcomes"), "file_id", "arrival", "status") == [("f", 2, "success")]


@pytest.mark.parametrize("every", [1, 3, 100])
def test_newest_rows_of_each_key(spark, tmp_path, rows, every):
    rng = random.Random(every)
    want, path = {}, str(tmp_path / "t")
    for batch in range(8):
        touched = {rng.randrange(12): rng.randrange(4) for _ in range(4)}
        data = [(k, f"{batch}-{i}") for k, n in touched.items() for i in range(n)]
        df = spark.createDataFrame(data, "k int, v string")
        keys = spark.createDataFrame([(k,) for k in touched], "k int")
        for _ in range(1 + batch % 2):  # every second batch runs twice
            current.write_changes(df, ["k"], path, batch, keys, every)
        want |= {k: [v for c, v in data if c == k] for k in touched}
        assert rows(current.read_current(spark, path)) == sorted(((k, v) for k, some in want.items() for v in some), key=repr)
    left = [p.name for p in (tmp_path / "t").iterdir()]
    assert len(left) <= 2 * min(8, 2 * every + 2)
    with pytest.raises(FileNotFoundError):
        current.read_current(spark, f"{path}-none")


def test_an_unfinished_base_does_not_count(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    for batch in range(3):
        df = spark.range(2).select(F.col("id").alias("k"), F.lit(batch).alias("v"))
        current.write_changes(df, ["k"], path, batch)
    df.limit(0).withColumn("_batch", F.lit(2).cast("long")).write.parquet(f"{path}/base-rows-2")
    (tmp_path / "t" / "base-keys-2").mkdir()
    assert rows(current.read_current(spark, path)) == [(0, 2), (1, 2)]
    current.compact(spark, path, 2)
    assert rows(current.read_current(spark, path)) == [(0, 2), (1, 2)]
