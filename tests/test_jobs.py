import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import diff, jobs as J, naming, ordered, outcomes, retention, timing
from gradeloom.plans import operations
from gradeloom.schemas import JOB_EVENTS, JOBS
from gradeloom.sources import files as sources
from gradeloom.sources.derived_jobs import lifecycle
from gradeloom.streaming.job_state import read_job_state, update_job_state

T0 = dt.datetime(2024, 1, 1)


def events(spark, *items):
    base = dict.fromkeys(JOB_EVENTS.names)
    data = [
        base | {"job_id": "job-1", "seq": n, "event": event, "ts": T0 + dt.timedelta(seconds=n)} | extra
        for n, (event, extra) in enumerate(items)
    ]
    return spark.createDataFrame([tuple(d[c] for c in JOB_EVENTS.names) for d in data], JOB_EVENTS)


def test_job_lifecycle(spark):
    ev = events(
        spark,
        ("created", {"request_type": "pdf", "source_name": "a.pdf", "source_file_count": 1}),
        ("started", {}),
        ("progress", {"stage": "processing", "metadata_json": '{"step": 1}', "progress_current": 0, "progress_total": 1}),
        ("source_count", {"source_file_count": 4}),
        ("artifact", {"metadata_json": '{"b": 2}', "debug_path": "/x"}),
        ("artifact", {"metadata_json": '{"c": 3}'}),
        ("success", {"returned_name": "a.xlsx", "returned_file_count": 1}),
    )
    job = J.fold_events(ev).first()
    assert (job.status, job.stage, job.source_file_count) == ("success", "processing", 4)
    assert (job.debug_path, job.metadata_json) == (None, '{"c": 3}')  # replaced whole
    assert job.started_at == T0 + dt.timedelta(seconds=1)
    assert job.completed_at == job.returned_at == job.updated_at == T0 + dt.timedelta(seconds=6)


def test_counts_of_jobs_and_files(spark):
    jobs = spark.createDataFrame([("success",), ("error",), ("processing",)], "status string")
    files = spark.createDataFrame([], "status string")
    got = operations.admin_counts(jobs, files).first().asDict()
    assert got == {"total_jobs": 3, "success_jobs": 1, "error_jobs": 1, "total_files": 0,
                   "success_files": None, "error_files": None}


def test_lists_break_ties_by_id(spark):
    jobs = spark.createDataFrame(
        [(1, "job-1", "error", T0, None), (2, "job-2", "error", T0, None), (3, "job-3", "success", T0, None)],
        "id long, job_id string, status string, created_at timestamp, completed_at timestamp",
    )
    assert [r.id for r in J.recent(jobs, 2).collect()] == [3, 2]
    assert [r.job_id for r in J.error_jobs_oldest_first(jobs).collect()] == ["job-1", "job-2"]
    assert J.find_job(jobs, "job-2").first().id == 2


def test_progress_columns(spark, rows):
    jobs = spark.createDataFrame(
        [("a", "success", None, None, 2, 3), ("b", "x", "s", "m", 9, 0), ("c", "x", "s", "m", None, None)],
        "job_id string, status string, stage string, progress_message string, progress_current int, progress_total int",
    )
    got = rows(J.progress_view(jobs), "job_id", "progress_current", "progress_total", "percent", "download_ready")
    assert got == [("a", 2, 3, 66, True), ("b", 1, 1, 100, False), ("c", 0, 1, 0, False)]


def test_metadata_that_is_no_object_counts_as_empty(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("junk",), ("",), (None,)], "m string")
    assert [len(r[0]) for r in df.select(J.metadata_map(F.col("m"))).collect()] == [1, 0, 0, 0, 0]


def test_old_tables_get_the_missing_columns(spark):
    old = spark.createDataFrame([("j",)], "job_id string")
    row = J.with_missing_columns(old, JOBS, {"progress_current": 0, "progress_total": 1}).first()
    assert (row.job_id, row.stage, row.progress_current, row.progress_total) == ("j", None, 0, 1)


def test_stream_state_equals_batch_state(spark, tmp_path):
    data = [(i, T0 + dt.timedelta(seconds=i), i % 7, ["signup", "click", "view", "purchase", "error"][i * 5 % 11 % 5], "{}")
            for i in range(300)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, props string")
    half = F.col("event_id") < 150
    source = str(tmp_path / "in")
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (df.filter(half), df.filter(~half)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        update_job_state(lifecycle(stream), target, checkpoint)
    batch = J.fold_events(lifecycle(df))
    state = read_job_state(spark, target).select(*batch.columns)
    assert sorted(map(repr, state.collect())) == sorted(map(repr, batch.collect()))


def test_file_without_tables(spark):
    files = spark.createDataFrame([("f",)], "file_id string")
    cells = spark.createDataFrame([], "file_id string, header string")
    records = spark.createDataFrame([], "file_id string, student string, code string, kind string")
    row = outcomes.classify_files(files, cells, records).first()
    assert (row.reason, row.error_message) == ("no_tables", "No objects to concatenate")
    assert row.public_message.startswith("No s'han pogut extreure")


FILES = "id long, job_id string, source_name string, status string, error_message string"


def test_batch_outcomes_and_texts(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 2)
    data = [(i, "all", f"f{i}.pdf", "error", "list index out of range") for i in range(5)]
    data += [(10, "some", "a.pdf", "success", None), (11, "some", "b.pdf", "error", "boom")]
    data += [(20, "fine", "c.pdf", "success", None)]
    files = spark.createDataFrame(data, FILES)
    got = {r.job_id: r for r in outcomes.batch_outcomes(files).collect()}
    assert got["all"].error_message == (
        "No s'ha pogut convertir cap fitxer del lot. Fitxers amb error: f0.pdf, f1.pdf, f2.pdf, ...."
    )
    assert (got["all"].status, got["all"].file_rows) == ("error", 6)
    assert (got["some"].outcome, got["some"].status, got["some"].error_message) == ("partial", "success", None)
    assert got["fine"].outcome == "success"
    jobs = spark.createDataFrame(
        [("all", "zip", "l.zip", "E", "/d"), ("some", "zip", "m.zip", None, "/e"), ("fine", "zip", "n.zip", None, None)],
        "job_id string, request_type string, source_name string, error_message string, debug_path string",
    )
    texts = {r.job_id: r for r in outcomes.incident_texts(jobs, files, "[x] ").collect()}
    assert set(texts) == {"all", "some"}
    assert texts["some"].subject == "[x] Partial conversion failure for m.zip"
    assert "1 fitxer convertit correctament i 1 fitxer amb error." in texts["some"].body
    assert texts["all"].body.count("- Fitxer: ") == 5 and "  Debug path: /d\n\n- Fitxer: f1.pdf" in texts["all"].body


def _plan(jobs, sizes, total, limit):
    """Oldest first until the folder fits."""
    gone = []
    for job in jobs:
        if total <= limit:
            break
        total -= sizes[job]
        gone.append(job)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_retention_equals_deleting_one_by_one(spark, rows, monkeypatch, seed):
    monkeypatch.setattr(ordered, "BLOCK", 3)
    rng = random.Random(seed)
    jobs, art, sizes = [], [], {}
    for n in range(25):
        status = rng.choice(["error", "error", "success"])
        at = T0 + dt.timedelta(days=rng.randrange(20))
        path = f"/failed/j{n}"
        jobs.append((n, f"j{n}", status, at, None, path, None))
        sizes[f"j{n}"] = 0
        for k in range(rng.randrange(3)):
            size = rng.randrange(1, 5) << 20
            art.append((f"j{n}", f"{path}/f{k}", size))
            sizes[f"j{n}"] += size
    df = spark.createDataFrame(
        jobs, "id long, job_id string, status string, created_at timestamp, completed_at timestamp, "
        "debug_path string, metadata_json string",
    )
    listing = spark.createDataFrame(art, "job_id string, path string, size_bytes long")
    now, limit = T0 + dt.timedelta(days=20), 20 << 20
    waiting = [j for j in sorted(jobs, key=lambda j: (j[3], j[0])) if j[2] == "error" and sizes[j[1]]]
    old = [j[1] for j in waiting if now - j[3] > dt.timedelta(days=12)]
    young = [j[1] for j in waiting if j[1] not in old]
    left = sum(sizes.values()) - sum(sizes[j] for j in old)
    want = [(j, "retention>12d") for j in old] + [(j, "size-limit>20MB") for j in _plan(young, sizes, left, limit)]
    got = rows(retention.retention_plan(df, listing, now, 12, limit), "job_id", "reason")
    assert got == sorted(want, key=repr)
    assert retention.expired_jobs(df, listing, now, -1).count() == 0
    assert retention.oldest_with_artifacts(df, listing).first().job_id == waiting[0][1]
    assert retention.retained_bytes(listing).first()[0] == sum(sizes.values())


def test_artifact_flags_look_at_files_and_folders(spark):
    jobs = spark.createDataFrame(
        [("a", "/failed/a", '{"failed_source_path": "/failed/a/s.pdf", "failure_log_path": "/gone"}'), ("b", "/failed/b", "{}")],
        "job_id string, debug_path string, metadata_json string",
    )
    listing = spark.createDataFrame([("a", "/failed/a/s.pdf", 3), ("c", "/failed/bb/x", 1)], "job_id string, path string, size_bytes long")
    got = J.artifact_flags(jobs, listing).collect()
    assert [tuple(r) for r in got] == [("a", True, True, False)]


def _taken(names):
    """Each name in turn; a taken one is numbered."""
    used, out = set(), []
    for name in names:
        dot = name.rfind(".")
        stem, end = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        pick, n = name, 1
        while pick in used:
            pick, n = f"{stem}-{n}{end}", n + 1
        used.add(pick)
        out.append(pick)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_equal_one_by_one_numbering(spark, rows, monkeypatch, seed):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    rng = random.Random(seed)
    pool = ["a.pdf", "a-1.pdf", "a-2.pdf", "a-3.pdf", "a-1-1.pdf", "a-1-1-1.pdf", "b", "b-1", "b-2", ".pdf", ".pdf-1",
            "a-01.pdf", "x-1.pdf", "a.b.pdf", "a.b-1.pdf"]
    data, want = [], []
    for key in range(25):
        names = [rng.choice(pool[: rng.choice([3, 6, len(pool)])]) for _ in range(rng.randrange(1, 25))]
        data += [(key, pos * 2, name) for pos, name in enumerate(names)]
        want += [(key, pos * 2, pick) for pos, pick in enumerate(_taken(names))]
    df = spark.createDataFrame(data, "k int, pos long, name string")
    got = rows(naming.unique_names(df, "k", "pos", "name"), "k", "pos", "unique_name")
    assert got == sorted(want, key=repr)


def test_many_literals_and_deep_chains_of_one_name(spark, rows):
    rng = random.Random(8)
    names = [f"a-{k}.pdf" for k in rng.sample(range(1, 9_000), 4_000)] + ["a.pdf"] * 3_000
    deep = ["b" + "-1" * n for n in range(30)] * 2
    rng.shuffle(names)
    data = [(None, pos, name) for pos, name in enumerate(names)] + [(1, pos, name) for pos, name in enumerate(deep)]
    want = [(None, pos, pick) for pos, pick in enumerate(_taken(names))]
    want += [(1, pos, pick) for pos, pick in enumerate(_taken(deep))]
    df = spark.createDataFrame(data, "k int, pos long, name string").repartition(3)
    got = rows(naming.unique_names(df, "k", "pos", "name"), "k", "pos", "unique_name")
    assert got == sorted(want, key=repr)


def test_archive_members(spark, rows):
    members = spark.createDataFrame(
        [("z", 0, ".DS_Store", False), ("z", 1, "grades.pdf", False), ("z", 2, "nested/grades.pdf", False),
         ("z", 3, "notes.txt", False), ("z", 4, "dir.pdf/", True), ("z", 5, "x/.pdf", False), ("z", 6, "B.PDF", False)],
        "archive_id string, member_pos long, path string, is_dir boolean",
    )
    named = naming.unique_names(naming.select_members(members), "archive_id", "member_pos", "name")
    assert rows(named, "unique_name") == [("B.PDF",), ("grades-1.pdf",), ("grades.pdf",)]


def test_bundles_name_outputs_once(spark, rows):
    outputs = spark.createDataFrame([("j", 0, "report.xlsx"), ("j", 1, "report.xlsx")], "job_id string, pos long, output_name string")
    got = rows(sources.bundle_manifest(outputs), "bundle_name", "content_type")
    assert got == [("report-1.xlsx", naming.SHEET_CONTENT_TYPE), ("report.xlsx", naming.SHEET_CONTENT_TYPE)]


def test_upload_checks(spark):
    uploads = {"none": [" "], "bad": ["a.pdf", "b.txt", "c.zip"], "mixed": ["a.pdf", "b.zip"],
               "zip": ["a.ZIP"], "pdf": ["a.pdf"], "many": ["a.pdf", "b.PDF"]}
    df = spark.createDataFrame([(k, n) for k, names in uploads.items() for n in names], "request_id string, name string")
    requests = df.select("request_id").distinct()
    got = {r.request_id: (r.request_type, r.reject_reason) for r in naming.check_uploads(requests, df).collect()}
    assert got == {"none": (None, naming.NO_FILES), "bad": (None, naming.BAD_SUFFIX), "mixed": (None, naming.MIXED_BATCH),
                   "zip": ("zip", None), "pdf": ("pdf", None), "many": ("pdf_batch", None)}


def test_group_code_is_the_line_after_the_marker(spark):
    texts = ["x\nCodi del grup:\n  A B 1 \nz", "Codi del grup", "no", "a Codi del grup\nCodi del grup\nX", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(sources.group_code(F.col("t"))).collect()]
    assert got == ["A_B_1", "unknown_group", "unknown_group", "Codi_del_grup", "unknown_group"]


def test_folders_are_listed_without_reading(spark, tmp_path, rows):
    (tmp_path / "j1" / "sub").mkdir(parents=True)
    (tmp_path / "b.pdf").write_bytes(b"12")
    (tmp_path / "a.pdf").write_bytes(b"1")
    (tmp_path / "j1" / "sub" / "x.log").write_bytes(b"123")
    found = sources.list_reports(spark, str(tmp_path))
    assert [(r.name, r.size_bytes) for r in found.collect()] == [("a.pdf", 1), ("b.pdf", 2)]
    listed = sources.folder_listing(spark, str(tmp_path)).filter("job_id = 'j1'")
    assert rows(listed, "job_id", "size_bytes") == [("j1", 3)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        sources.list_reports(spark, str(tmp_path / "empty"))


def test_sheets_of_two_reports_with_one_group_code_are_both_kept(spark, tmp_path, rows):
    path = str(tmp_path / "sheets")
    cells = spark.createDataFrame(
        [("f1", 1, "G", "1"), ("f2", 1, "G", "2")], "file_id string, row_no long, group_code string, value string"
    )
    sources.write_sheets(cells, path)
    assert rows(sources.read_sheets(spark, path), "file_id", "value") == [("f1", "1"), ("f2", "2")]
    # A later run replaces its own reports only.
    later = [("f2", 1, "G", "3"), ("f3", 1, "G", "4")] + [("f3", n * 100_000, "G", "5") for n in range(3)]
    sources.write_sheets(spark.createDataFrame(later, cells.schema), path)
    got = rows(sources.read_sheets(spark, path), "file_id", "value")
    assert got == [("f1", "1"), ("f2", "3")] + [("f3", "4")] + [("f3", "5")] * 3


def test_single_reports_and_jobs_without_files(spark):
    jobs = spark.createDataFrame(
        [("p", "pdf", "a.pdf", "raw", "/d"), ("z", "zip", "b.zip", "No PDF in it.", "/e"), ("r", "zip", "c.zip", None, None)],
        "job_id string, request_type string, source_name string, error_message string, debug_path string",
    )
    files = spark.createDataFrame(
        [(1, "p", "a.pdf", "error", "list index out of range")],
        "id long, job_id string, source_name string, status string, error_message string",
    )
    got = {r.job_id: (r.outcome, r.error_message, r.file_rows) for r in outcomes.batch_outcomes(files, jobs=jobs).collect()}
    assert got == {"p": ("error", "list index out of range", 1), "z": ("error", "No PDF in it.", 1)}
    texts = {r.job_id: r.body for r in outcomes.incident_texts(jobs, files).collect()}
    assert set(texts) == {"p", "z"}
    assert texts["z"].endswith("i 0 fitxers amb error.\nError principal: No PDF in it.\n")


def test_audit_rows_are_appended(spark, tmp_path):
    path = str(tmp_path / "jobs")
    requests = spark.createDataFrame(
        [(1, "j", "pdf", "a.pdf", 5, 1, None)],
        "id long, job_id string, request_type string, source_name string, source_size_bytes long, "
        "source_file_count int, remote_addr string",
    )
    new = J.with_missing_columns(sources.new_jobs(requests, F.lit(T0)), JOBS, {})
    for batch in ("a", "b", "a"):  # the first comes again, as after a failure
        sources.append_rows(new, "jobs", path, batch)
    read = sources.read_table(spark, "jobs", path)
    assert read.columns == JOBS.names and read.count() == 2 and read.first().status == "received"


def test_jobs_that_failed_whole_have_a_row_of_their_own(spark, rows):
    jobs = spark.createDataFrame(
        [("p", "pdf", "a.pdf", "raw"), ("z", "zip", "b.zip", "No PDF in it."), ("r", "zip", "c.zip", None),
         ("m", "pdf_batch", "d.zip", None)],
        "job_id string, request_type string, source_name string, error_message string",
    )
    files = spark.createDataFrame(
        [(1, "p", "a.pdf", None, "error", "x", T0), (2, "r", "q.pdf", None, "error", "y", T0),
         (3, "m", "u.pdf", "u.xlsx", "success", None, T0), (4, "m", "v.pdf", None, "error", "z", T0)],
        "id long, job_id string, source_name string, output_name string, status string, error_message string, created_at timestamp",
    )
    trail = outcomes.audit_file_rows(files, jobs, F.lit(T0))
    got = rows(trail.filter("id is null"), "job_id", "source_name", "status", "error_message")
    assert got == [
        ("r", "c.zip", "error", "No s'ha pogut convertir cap fitxer del lot. Fitxers amb error: q.pdf."),
        ("z", "b.zip", "error", "No PDF in it."),
    ]
    assert trail.count() == 6


def test_sheet_comparison(spark, rows):
    kind = "sheet_id string, row_no long, col_no int, value string"
    left = spark.createDataFrame([("s", 1, 1, "h"), ("s", 2, 1, "a"), ("s", 3, 1, None), ("t", 1, 1, "x")], kind)
    right = spark.createDataFrame([("s", 1, 1, "h"), ("s", 2, 1, "b"), ("t", 1, 1, "y"), ("t", 1, 2, "z")], kind)
    assert rows(diff.differences(left, right), "sheet_id", "row_no", "col_no") == [("s", 2, 1), ("t", 1, 1), ("t", 1, 2)]
    assert [tuple(r)[:3] for r in diff.first_differences(left, right, 1).collect()] == [("s", 2, 1)]
    got = rows(diff.compare_sheets(left, right), "sheet_id", "same_dimensions", "same_headers", "n_diffs")
    assert got == [("s", False, True, 1), ("t", False, False, 2)]


def test_timing_lines_survive_the_round_trip(spark, rows):
    made = spark.createDataFrame(
        [("export", 1.23456789, [("write", 0.5)], {"n": "1"}), ("export", 3.0, [("write", 1.5)], {})],
        "label string, total_seconds double, stages array<struct<name:string,seconds:double>>, context map<string,string>",
    )
    lines = timing.format_timings(made).unionByName(spark.createDataFrame([("noise",), ("[PERF] junk",)], "value string"))
    back = timing.parse_timings(lines)
    assert rows(timing.run_statistics(back)) == [("export", 2, 2.117284, 1.234568, 3.0)]
    assert rows(timing.stage_totals(back)) == [("export", "write", 2, 2.0)]


def test_families_of_many_keys_are_decided_together(spark):
    import pyarrow as pa

    # Two repeats of a.pdf came before a-1.pdf under the first key, none under the second.
    table = pa.table({
        "_key": pa.array([{"k": 1}, {"k": 2}]), "_depth": [3, 3], "_name": ["a.pdf"] * 2, "_k": [1, 1],
        "_seen": [3, 1], "_literal": ["a-1.pdf"] * 2,
    })
    got = naming._decide()(table).to_pylist()
    assert [(r["_key"]["k"], r["_name"], r["_kept"], r["_skip"]) for r in got] == [
        (2, "a-1.pdf", True, None), (2, "a.pdf", None, 1), (1, "a-1.pdf", False, None),
    ]
