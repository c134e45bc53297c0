"""JSON page lines with broken ones, lookups that skip files, manifests and titled comparison."""

import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gradeloom.operators import diff
from gradeloom.operators.jobs import find_job
from gradeloom.sources.files import list_reports, write_lookup
from gradeloom.sources.json_pages import bad_reports, read_page_lines


def test_page_lines_and_quarantine(spark, tmp_path, rows):
    good = [
        {"file_id": "a", "page_no": 1, "rows": [["h", "k"], ["x", None], []], "more": {"file_id": "z"}},
        {"file_id": "a", "page_no": 2, "rows": []},
        {"page_no": 1, "rows": [["only"]], "file_id": "b"},
    ]
    bad = ['{"file_id": "c", "page_no": 1, "rows": [["h"', "no json", '{"file_id": "d", "rows": [["q"]]}',
           '{"file_id": "d", "page_no": 3}', '{"page_no": 1, "rows": []}', '{"file_id": "e", "page_no": "x", "rows": []}']
    (tmp_path / "lines.json").write_text("\n".join([*map(json.dumps, good), "", *bad]) + "\n")
    cells, aside = read_page_lines(spark, str(tmp_path))
    assert rows(cells) == sorted([
        ("a", 1, 0, 0, "h"), ("a", 1, 0, 1, "k"), ("a", 1, 1, 0, "x"), ("a", 1, 1, 1, None), ("b", 1, 0, 0, "only"),
    ], key=repr)
    found = aside.select("reason", "line").collect()
    assert sorted(r[1] for r in found if r[0] == "malformed") == sorted([bad[0], bad[1], bad[5]])
    assert sorted(r[0] for r in found if r[0] != "malformed") == ["no_file_id", "no_page_no", "no_rows"]
    told = {r[0]: (r[1], r[2]) for r in bad_reports(aside).collect()}
    assert told["d"] == (2, "no_page_no,no_rows")
    # Good pages of a report with a broken one can be left out by an anti-join.
    whole = cells.join(bad_reports(aside).filter("file_id is not null"), ["file_id"], "left_anti")
    assert whole.count() == 5


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    cells, aside = read_page_lines(spark, str(tmp_path))
    assert cells.count() == 0 and bad_reports(aside).count() == 0


def test_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "jobs")
    jobs = spark.range(4_000).select(F.concat(F.lit("job-"), F.col("id").cast("string")).alias("job_id"), "id")
    write_lookup(jobs.unionByName(jobs.filter("id = 77")), "job_id", path, files=4)
    found = find_job(spark.read.parquet(path), "job-77")
    assert [r["id"] for r in found.collect()] == [77, 77]
    assert find_job(spark.read.parquet(path), "job-4001").count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(job_id,job-77)" in plan.split("PushedFilters")[-1]
    # The ranges of the files do not overlap, so a reader opens one of them only.
    ranges = []
    for file in tmp_path.glob("jobs/*.parquet"):
        groups = pq.ParquetFile(file).metadata
        stats = [groups.row_group(i).column(0).statistics for i in range(groups.num_row_groups)]
        ranges.append((min(s.min for s in stats), max(s.max for s in stats)))
    ranges.sort()
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert sum(low <= "job-77" <= high for low, high in ranges) == 1


def test_manifest_of_a_folder(spark, tmp_path):
    for name, text in [("b.txt", "xyz"), ("a.txt", "12"), ("c.pdf", "1"), ("empty.txt", "")]:
        (tmp_path / name).write_text(text)
    found = list_reports(spark, str(tmp_path), "*.txt").collect()
    assert [(r["name"], r["size_bytes"]) for r in found] == [("a.txt", 2), ("b.txt", 3)]


def test_titles_and_headers(spark):
    def cells(*values):
        return spark.createDataFrame(values, "sheet_id string, row_no int, col_no int, value string")

    def titles(*values):
        return spark.createDataFrame(values, "sheet_id string, title string")

    left = cells(("s", 1, 1, "h"), ("s", 2, 1, "v"), ("t", 1, 1, "h"), ("u", 1, 1, "h"))
    right = cells(("s", 1, 1, "h"), ("s", 2, 1, "w"), ("t", 1, 1, "k"))
    got = {r["sheet_id"]: r for r in diff.compare_titled(
        left, right, titles(("s", "S"), ("t", "T"), ("u", "U"), ("e", None)), titles(("s", "S"), ("t", "X"), ("e", None)),
    ).collect()}
    flags = {k: (r["same_sheet_title"], r["same_dimensions"], r["same_headers"], r["n_diffs"]) for k, r in got.items()}
    assert flags == {
        "s": (True, True, True, 1), "t": (False, True, False, 1), "u": (False, False, False, 1),
        "e": (True, True, True, 0),
    }
