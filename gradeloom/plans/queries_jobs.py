"""Registered queries over uploads, jobs, outcomes, retention, comparison and timings."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, jobs as J, naming, outcomes, retention, timing
from ..session import shared_folder
from ..sources import derived as D, derived_jobs as S
from ..sources.files import (
    append_rows, bundle_manifest, list_reports, read_generations, read_table, write_lookup,
)
from ..sources.json_pages import bad_reports, read_page_lines
from ..streaming.ingest import ingest_reports, read_ingested
from ..streaming.job_state import read_job_state, update_job_state
from . import operations, reports

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


# --- job state -------------------------------------------------------------------------

@query(S.LIFECYCLE_SQL)
def job_state(spark: SparkSession, folder: str) -> DataFrame:
    """Current row of each job from its lifecycle events."""
    return J.fold_events(S.lifecycle(D.table(spark, folder, "events")))


def _run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(S.LIFECYCLE_SQL)
def job_state_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same fold, run as a stream over the event files."""
    schema = D.table(spark, folder, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    stream = reader.parquet(folder)
    run = _run_folder(spark, "job-state")
    update_job_state(S.lifecycle(stream), f"{run}/rows", f"{run}/checkpoint")
    return read_job_state(spark, f"{run}/rows")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One report per nation."""
    k = F.col("n_nationkey")
    return D.table(spark, folder, "nation").select(
        k.alias("file_id"), F.concat(F.lit("job-"), (k % 4).cast("string")).alias("job_id"),
        F.concat(F.lit("acta-"), k.cast("string"), F.lit(".pdf")).alias("source_name"),
    )


def _with_counts(told: DataFrame, records: DataFrame) -> DataFrame:
    counts = records.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_records"))
    columns = ["file_id", "status", "reason", "error_message", "public_message"]
    return told.select(*columns).join(counts, ["file_id"], "left").na.fill(0, ["n_records"])


@query(f"WITH {D.GRADES_SQL}, {D.outcome_sql('k % 7')} SELECT * FROM told")
def report_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each report in one batch run, from raw cells, and its records."""
    cells = D.damaged_cells(D.raw_cells(spark, folder), F.col("file_id") % 7)
    records, told = reports.convert_reports(cells, _manifest(spark, folder))
    return _with_counts(told, records)


def _ingested(spark: SparkSession, folder: str) -> str:
    """Two arrivals: all reports, some damaged; then every third again, with another damage."""
    run = _run_folder(spark, "ingest")
    cells, files = D.raw_cells(spark, folder), _manifest(spark, folder)
    k = F.col("file_id")
    for arrival, (chosen, kind) in enumerate([(F.lit(True), k % 7), (k % 3 == 0, (k + 3) % 7)]):
        D.damaged_cells(cells.filter(chosen), kind).write.parquet(f"{run}/cells/arrival={arrival}")
        named = files.filter(chosen).withColumn("arrival", F.lit(arrival).cast("long"))
        named.coalesce(1).write.mode("append").parquet(f"{run}/manifest")
    schema = spark.read.parquet(f"{run}/manifest").schema
    ingest_reports(
        spark, f"{run}/manifest", f"{run}/cells", f"{run}/out", f"{run}/checkpoint",
        schema=schema, cell_schema=cells.schema, files_per_batch=1,
    )
    return f"{run}/out"


_FINAL_DAMAGE = "(CASE WHEN k % 3 = 0 THEN (k + 3) % 7 ELSE k % 7 END)"
_INGEST_SQL = f"WITH {D.GRADES_SQL}, {D.outcome_sql(_FINAL_DAMAGE)}"


@query(f"""{_INGEST_SQL} SELECT r.file_id, r.student, r.code, r.kind, r.grade_num, r.grade_text
FROM records r JOIN told USING (file_id) WHERE status = 'success'""")
def ingest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Reports taken in as a stream of arrivals, some twice: the grades that hold in the end."""
    found = read_ingested(spark, _ingested(spark, folder), "records")
    return found.select("file_id", "student", "code", "kind", "grade_num", "grade_text")


@query(f"""{_INGEST_SQL}, sheets AS (SELECT r.file_id, count(DISTINCT r.student) AS n_students
FROM records r JOIN told USING (file_id) WHERE status = 'success' GROUP BY 1)
SELECT t.*, coalesce(n_students, 0) AS n_students FROM told t LEFT JOIN sheets USING (file_id)""")
def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each report of the same stream, with its records and the rows of its sheet."""
    out = _ingested(spark, folder)
    told = _with_counts(read_ingested(spark, out, "outcomes"), read_ingested(spark, out, "records"))
    sheets = read_ingested(spark, out, "sheets").groupBy("file_id").agg(
        F.countDistinct("row_no").alias("n_students")
    )
    return told.join(sheets, ["file_id"], "left").na.fill(0, ["n_students"])


_JOBS = f"WITH {S.JOBS_SQL}"
_FILES = f"WITH {S.BATCH_SQL}"


@query(f"""{_JOBS}, {S.BATCH_SQL}, f AS (SELECT count(*) AS n, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS s,
 sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS e FROM files)
SELECT count(*) AS total_jobs, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS success_jobs,
 CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_jobs, (SELECT n FROM f) AS total_files,
 (SELECT CAST(s AS BIGINT) FROM f) AS success_files, (SELECT CAST(e AS BIGINT) FROM f) AS error_files FROM jobs""")
def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs and files in total, converted and failed."""
    return operations.admin_counts(S.jobs(spark, folder), S.batch_files(spark, folder))


@query(f"""{_JOBS} SELECT job_id, status, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 100""")
def recent_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 newest jobs."""
    return J.recent(S.jobs(spark, folder), 100).select("job_id", "status", "created_at")


@query(f"""{_FILES} SELECT job_id, source_name, output_name, status, error_message, created_at
FROM files ORDER BY created_at DESC, id DESC LIMIT 200""")
def recent_files(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 newest file results."""
    return operations.admin_files(S.batch_files(spark, folder)).drop("id")


@query(f"""{_JOBS} SELECT job_id, coalesce(completed_at, created_at) AS since FROM jobs WHERE status = 'error'""")
def error_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Failed jobs, oldest first."""
    found = J.error_jobs_oldest_first(S.jobs(spark, folder))
    return found.select("job_id", J.reference_time().alias("since"))


@query("""SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderkey = 77""")
def job_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One job by its id."""
    jobs = D.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at")
    )
    return J.find_job(jobs, 77).withColumnRenamed("job_id", "id")


@query(f"{_JOBS} SELECT job_id, status, created_at FROM jobs WHERE job_id = 'job-77'")
def job_lookup_pushed(spark: SparkSession, folder: str) -> DataFrame:
    """One job by its id, from a table written for lookups: the scan skips files and row groups."""
    path = f"{_run_folder(spark, 'lookup')}/jobs"
    write_lookup(S.jobs(spark, folder).select("job_id", "status", "created_at"), "job_id", path)
    return J.find_job(spark.read.parquet(path), "job-77")


@query(f"""{_JOBS}, p AS (SELECT *, greatest(coalesce(nullif(progress_total, 0), 1), 1) AS t FROM jobs),
q AS (SELECT *, least(coalesce(progress_current, 0), t) AS c FROM p)
SELECT job_id, status, coalesce(stage, '') AS stage, coalesce(progress_message, '') AS message,
 c AS progress_current, t AS progress_total, CAST(trunc(c / t * 100) AS INTEGER) AS percent,
 status = 'success' AS download_ready FROM q""")
def progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress columns of every job."""
    return J.progress_view(S.jobs(spark, folder))


@query(f"""{_JOBS} SELECT job_id, CASE id % 6 WHEN 0 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS n_keys,
 CASE WHEN id % 6 = 0 THEN '/failed/' || job_id || '/source.pdf' END AS failed_source FROM jobs""")
def job_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of every job, whatever its column holds."""
    meta = J.metadata_map(F.col("metadata_json"))
    return S.jobs(spark, folder).select(
        "job_id", F.size(meta).alias("n_keys"),
        F.try_element_at(meta, F.lit("failed_source_path")).alias("failed_source"),
    )


_RETAINED = f"{_JOBS}, {S.ARTIFACTS_SQL}"


@query(f"""{_RETAINED}, r AS (SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 100)
SELECT r.job_id, f.has_failed_source, f.has_failure_log,
 CASE WHEN r.id % 6 = 4 THEN '2024-01-01T00:00:00+00:00' END AS artifacts_deleted_at
FROM r JOIN flags f ON f.job_id = r.job_id""")
def admin_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest jobs with the flags the overview shows."""
    found = operations.admin_jobs(S.jobs(spark, folder), S.artifacts(spark, folder))
    return found.select("job_id", "has_failed_source", "has_failure_log", "artifacts_deleted_at")


@query(f"""{_RETAINED} SELECT job_id, has_debug_path, has_failed_source, has_failure_log
FROM flags WHERE has_debug_path OR has_failed_source OR has_failure_log""")
def artifact_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Which retained paths of each job exist."""
    return J.artifact_flags(S.jobs(spark, folder), S.artifacts(spark, folder))


@query(f"""{_FILES} SELECT b.job_id, b.request_type, count(f.id) AS n_files,
 count(*) FILTER (WHERE f.status = 'error') AS n_failed
FROM batches b LEFT JOIN files f ON f.job_id = b.job_id GROUP BY ALL""")
def jobs_with_files(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with the counts of their files."""
    found = J.jobs_with_files(S.batch_jobs(spark, folder), S.batch_files(spark, folder))
    return found.select("job_id", "request_type", "n_files", "n_failed")


@query(f"""{_JOBS} SELECT job_id, status, CASE WHEN id % 2 = 1 THEN coalesce(progress_current, 0) ELSE 0 END AS progress_current,
 CASE WHEN id % 2 = 1 THEN coalesce(progress_total, 1) ELSE 1 END AS progress_total,
 CASE WHEN id % 2 = 1 THEN stage END AS stage FROM jobs""")
def old_schema(spark: SparkSession, folder: str) -> DataFrame:
    """A job table with files of two generations, read in its present columns."""
    path = f"{_run_folder(spark, 'generations')}/jobs"
    jobs, first = S.jobs(spark, folder), ["id", "job_id", "status", "created_at"]
    jobs.filter("id % 2 = 0").select(*first).write.parquet(path)
    later = jobs.filter("id % 2 = 1").select(*first, "stage", "progress_current", "progress_total")
    later.write.mode("append").parquet(path)
    full = read_generations(spark, "jobs", path, {"progress_current": 0, "progress_total": 1})
    return full.select("job_id", "status", "progress_current", "progress_total", "stage")


# --- outcomes --------------------------------------------------------------------------

@query(f"""{_FILES}, r AS (
 SELECT b.job_id, coalesce(o.n_success, 0) AS n_success, coalesce(o.n_failed, 0) AS n_failed, failed_names,
  b.error_message AS own, request_type = 'pdf' AS single,
  (SELECT arg_min(f.error_message, f.id) FROM (SELECT * FROM files WHERE status = 'error') f WHERE f.job_id = b.job_id) AS raw
 FROM batches b LEFT JOIN outcomes o ON o.job_id = b.job_id)
SELECT job_id, n_success, n_failed,
 CASE WHEN n_success = 0 THEN 'error' WHEN n_failed > 0 THEN 'partial' ELSE 'success' END AS outcome,
 CASE WHEN n_success = 0 THEN 'error' ELSE 'success' END AS status,
 CASE WHEN n_success > 0 THEN NULL WHEN n_failed = 0 THEN own WHEN single THEN raw
  ELSE 'No s''ha pogut convertir cap fitxer del lot. Fitxers amb error: ' || failed_names || '.' END AS error_message,
 n_success + n_failed + CASE WHEN n_success = 0 AND (n_failed = 0 OR NOT single) THEN 1 ELSE 0 END AS file_rows FROM r""")
def batch_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each batch, single reports and batches without files included."""
    return outcomes.batch_outcomes(S.batch_files(spark, folder), jobs=S.batch_jobs(spark, folder))


@query(f"""{_FILES}, whole AS (
 SELECT b.job_id, b.source_name, b.request_type = 'pdf' AS single, b.error_message AS own,
  coalesce(o.n_failed, 0) AS n_failed, o.failed_names
 FROM batches b LEFT JOIN outcomes o ON o.job_id = b.job_id WHERE coalesce(o.n_success, 0) = 0)
SELECT job_id, source_name, output_name, status, error_message FROM files
UNION ALL SELECT job_id, source_name, NULL, 'error', CASE WHEN n_failed = 0 THEN own
 ELSE 'No s''ha pogut convertir cap fitxer del lot. Fitxers amb error: ' || failed_names || '.' END
FROM whole WHERE n_failed = 0 OR NOT single""")
def audit_append(spark: SparkSession, folder: str) -> DataFrame:
    """File rows of the audit trail, written in batches of which one comes twice, and read back."""
    path = f"{_run_folder(spark, 'audit')}/files"
    jobs = S.batch_jobs(spark, folder)
    now = F.lit("2025-01-01").cast("timestamp")
    rows = outcomes.audit_file_rows(S.batch_files(spark, folder), jobs, now)
    share = F.pmod(F.xxhash64("job_id"), F.lit(2))
    for batch in (0, 1, 0):
        append_rows(rows.filter(share == batch), "files", path, f"run-{batch}")
    return read_table(spark, "files", path).drop("id", "created_at")


@query(f"{_FILES} SELECT job_id, n_failed, failed_names FROM outcomes WHERE n_failed > 0")
def failed_names(spark: SparkSession, folder: str) -> DataFrame:
    """First three failed files of each batch."""
    return outcomes.first_failed_names(S.batch_files(spark, folder))


@query(f"{_FILES} SELECT id, public_message FROM files WHERE status = 'error'")
def public_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Public text of each failure."""
    failed = S.batch_files(spark, folder).filter(F.col("status") == "error")
    return failed.select("id", outcomes.public_error(F.col("error_message")).alias("public_message"))


@query(f"""{_FILES}, blocks AS (
 SELECT f.job_id, string_agg('- Fitxer: ' || f.source_name || chr(10) || '  Error principal: ' || f.public_message
  || chr(10) || '  Debug path: ' || b.debug_path, chr(10) || chr(10) ORDER BY f.id) AS blocks
 FROM files f JOIN batches b ON b.job_id = f.job_id WHERE f.status = 'error' GROUP BY f.job_id),
t AS (SELECT b.*, coalesce(o.n_success, 0) AS n_success, coalesce(o.n_failed, 0) AS n_failed, k.blocks,
  chr(10) || chr(10) || 'Job ID: ' || b.job_id || chr(10) || 'Tipus de peticio: ' || b.request_type || chr(10) AS head,
  CAST(coalesce(o.n_failed, 0) AS VARCHAR) || CASE WHEN o.n_failed = 1 THEN ' fitxer amb error' ELSE ' fitxers amb error' END AS failed_label
 FROM batches b LEFT JOIN outcomes o ON o.job_id = b.job_id LEFT JOIN blocks k ON k.job_id = b.job_id
 WHERE coalesce(o.n_failed, 1) > 0)
SELECT job_id, CASE WHEN n_success > 0 THEN 'Partial conversion failure for '
  WHEN request_type = 'pdf' THEN 'Conversion failed for ' ELSE 'Batch conversion failed for ' END || source_name AS subject,
 CASE WHEN n_success > 0 THEN 'Hi ha hagut una conversio parcial amb incidencies.' || head || 'Resultat: ' ||
   CAST(n_success AS VARCHAR) || CASE WHEN n_success = 1 THEN ' fitxer convertit correctament' ELSE ' fitxers convertits correctament' END
   || ' i ' || failed_label || '.' || chr(10) || 'Fitxers amb error:' || chr(10) || blocks || chr(10)
  WHEN request_type = 'pdf' THEN 'Ha fallat la conversio d''un fitxer.' || head || 'Fitxer: ' || source_name || chr(10)
   || 'Error principal: ' || error_message || chr(10) || 'Debug path: ' || debug_path || chr(10)
  ELSE 'Ha fallat la conversio completa d''un lot.' || head || 'Resultat: 0 fitxers convertits correctament i '
   || failed_label || '.' || chr(10) || 'Error principal: ' || error_message || chr(10)
   || coalesce('Fitxers amb error:' || chr(10) || blocks || chr(10), '') END AS body FROM t""")
def incident_text(spark: SparkSession, folder: str) -> DataFrame:
    """Report on each batch that had a failure."""
    return outcomes.incident_texts(S.batch_jobs(spark, folder), S.batch_files(spark, folder))


@query(f"""WITH {D.GRADES_SQL}, seen AS (SELECT c_custkey AS file_id,
  CASE c_custkey % 6 WHEN 0 THEN 'no_tables' WHEN 1 THEN 'null_header' WHEN 2 THEN 'no_name_column' END AS early
 FROM customer),
counted AS (SELECT student_id AS file_id, bool_or(kind = 'RA') AS has_ra FROM records GROUP BY 1),
r AS (SELECT s.file_id, coalesce(early, CASE WHEN NOT coalesce(has_ra, FALSE) THEN 'no_outcome_codes'
  WHEN s.file_id % 6 = 4 THEN 'duplicate_grades' END) AS reason FROM seen s LEFT JOIN counted c ON c.file_id = s.file_id)
SELECT file_id, CASE WHEN reason IS NULL THEN 'success' ELSE 'error' END AS status, reason,
 CASE reason WHEN 'no_tables' THEN 'No objects to concatenate' WHEN 'null_header' THEN 'expected string or bytes-like object'
  WHEN 'no_name_column' THEN '' WHEN 'no_outcome_codes' THEN '''code'''
  WHEN 'duplicate_grades' THEN 'Index contains duplicate entries, cannot reshape' END AS error_message,
 CASE WHEN reason = 'null_header' THEN 'El fitxer no té l''estructura esperada d''una acta.'
  WHEN reason = 'no_tables' THEN 'No s''han pogut extreure les taules necessàries del PDF.'
  WHEN reason IS NOT NULL THEN 'No s''ha pogut convertir aquest fitxer perquè no té el format esperat o hi ha hagut un error durant el procés.'
 END AS public_message FROM r""")
def file_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of each report; here one report per customer, some of them damaged."""
    files = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("file_id"))
    kind = F.col("file_id") % 6
    heads = F.when(kind == 1, F.array(F.lit("Nom\ni Cognoms"), F.lit(None))).when(
        kind == 2, F.array(F.lit("Nom"), F.lit("Codi"))
    ).otherwise(F.array(F.lit("Nom\ni Cognoms"), F.lit("Codi")))
    cells = files.filter(kind != 0).select("file_id", F.explode(heads).alias("header"))
    records = D.grade_records(spark, folder).withColumn("file_id", F.col("student_id"))
    copies = F.when(kind == 4, 2).otherwise(1)
    records = records.select("file_id", "student", "code", "kind", F.explode(F.sequence(F.lit(1), copies)))
    return outcomes.classify_files(files, cells, records)


# --- uploads and names -----------------------------------------------------------------

def _members(spark: SparkSession, folder: str) -> DataFrame:
    path = F.regexp_replace(F.split("url", "[?#]")[0], "^https?://", "")
    n = F.col("page_id")
    return D.table(spark, folder, "pages").select(
        F.regexp_extract("url", "^https?://[^/]*/([a-z]+)", 1).alias("archive_id"),
        n.alias("member_pos"),
        F.concat(path, F.when(n % 5 == 0, "/").when(n % 5 == 1, ".PDF").when(n % 5 == 2, "/.hidden.pdf")
                 .when(n % 5 == 3, ".txt").otherwise(".x.pdf")).alias("path"),
        (n % 5 == 0).alias("is_dir"),
    )


@query(r"""SELECT * FROM (SELECT regexp_extract(url, '^https?://[^/]*/([a-z]+)', 1) AS archive_id, page_id AS member_pos,
 list_extract(string_split(regexp_replace(string_split_regex(url, '[?#]')[1], '^https?://', ''), '/'), -1)
  || CASE WHEN page_id % 5 = 1 THEN '.PDF' ELSE '.x.pdf' END AS name
FROM pages WHERE page_id % 5 IN (1, 4)) WHERE NOT starts_with(name, '.')""")
def member_select(spark: SparkSession, folder: str) -> DataFrame:
    """Report files among the members of archives."""
    return naming.select_members(_members(spark, folder)).select("archive_id", "member_pos", "name")


@query("SELECT p_partkey, 'x/' || p_name || '.xlsx' AS path FROM part WHERE p_partkey % 3 <> 0")
def lock_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets without the lock files next to them."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("~$"), "p_name")).otherwise(F.col("p_name"))
    files = D.table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("x/"), name, F.lit(".xlsx")).alias("path")
    )
    return naming.skip_lock_files(files)


def _uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    requests = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("request_id"))
    k = F.col("o_orderkey")
    end = F.when(k % 40 == 0, ".zip").when(k % 41 == 0, ".txt").when(k % 2 == 0, ".PDF").otherwise(".pdf")
    uploads = D.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("request_id"), k.alias("pos"),
        F.concat(F.lit("acta-"), (k % 50).cast("string"), end).alias("name"),
        (k % 3).alias("size_bytes"), F.col("o_orderstatus").alias("last_modified"),
    )
    return requests, uploads


_UPLOADS_SQL = """WITH u AS (SELECT o_custkey AS request_id, o_orderkey AS pos, o_orderkey % 3 AS size_bytes,
 o_orderstatus AS last_modified, 'acta-' || CAST(o_orderkey % 50 AS VARCHAR) || CASE WHEN o_orderkey % 40 = 0 THEN '.zip'
  WHEN o_orderkey % 41 = 0 THEN '.txt' WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS name FROM orders)"""


@query(f"""{_UPLOADS_SQL}, n AS (SELECT c.c_custkey AS request_id, CAST(count(u.pos) AS INTEGER) AS n_files,
  count(*) FILTER (WHERE name LIKE '%.txt') AS bad, count(*) FILTER (WHERE name LIKE '%.zip') AS zips, min(name) AS name
 FROM customer c LEFT JOIN u ON u.request_id = c.c_custkey GROUP BY 1),
r AS (SELECT *, CASE WHEN n_files = 0 THEN 'Cal carregar almenys un fitxer PDF o ZIP.'
  WHEN bad > 0 THEN 'Només s''admeten fitxers PDF i ZIP.'
  WHEN n_files > 1 AND zips > 0 THEN 'Si carregues diversos fitxers alhora, tots han de ser PDF.' END AS reject_reason FROM n)
SELECT request_id, n_files, reject_reason,
 CASE WHEN reject_reason IS NULL THEN CASE WHEN n_files > 1 THEN 'pdf_batch' WHEN zips > 0 THEN 'zip' ELSE 'pdf' END END AS request_type,
 CASE WHEN reject_reason IS NULL THEN CASE WHEN n_files > 1 THEN 'selected_files-converted.zip' ELSE name END END AS source_name
FROM r""")
def upload_check(spark: SparkSession, folder: str) -> DataFrame:
    """Which upload requests are accepted, as what, or why not."""
    return naming.check_uploads(*_uploads(spark, folder))


@query(f"""{_UPLOADS_SQL} SELECT request_id, name, size_bytes, last_modified, min(pos) AS pos FROM u GROUP BY ALL""")
def upload_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Files picked twice in a request, kept once."""
    return naming.dedupe_uploads(_uploads(spark, folder)[1])


@query("""SELECT p_brand AS job_id, p_partkey AS pos, p_name || '.xlsx' AS output_name,
 p_name || CASE WHEN n > 1 THEN '-' || CAST(n - 1 AS VARCHAR) ELSE '' END || '.xlsx' AS bundle_name,
 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' AS content_type
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)""")
def bundle_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names and content types of the files in each download bundle."""
    return bundle_manifest(D.table(spark, folder, "part").select(
        F.col("p_brand").alias("job_id"), F.col("p_partkey").alias("pos"),
        F.concat("p_name", F.lit(".xlsx")).alias("output_name"),
    ))


@query("""WITH RECURSIVE src AS (
 SELECT o_custkey AS archive_id, o_orderkey AS pos,
  (['a.pdf', 'a-1.pdf', 'a.pdf', 'a-2.pdf', 'a-1-1.pdf', 'a.pdf', 'b', 'b-1'])[CAST(o_orderkey % 8 + 1 AS INTEGER)] AS name,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
walk(archive_id, i, taken, unique_name) AS (
 SELECT archive_id, i, [name], name FROM src WHERE i = 1
 UNION ALL
 SELECT t.archive_id, t.i, list_append(t.taken, t.pick), t.pick FROM (
  SELECT s.archive_id, s.i, w.taken,
   CASE WHEN NOT list_contains(w.taken, s.name) THEN s.name ELSE
    list_filter(list_transform(range(1, s.i + 1), lambda k: replace(s.name, '.pdf', '') || '-' || CAST(k AS VARCHAR)
     || CASE WHEN s.name LIKE '%.pdf' THEN '.pdf' ELSE '' END), lambda c: NOT list_contains(w.taken, c))[1] END AS pick
  FROM walk w JOIN src s ON s.archive_id = w.archive_id AND s.i = w.i + 1) t)
SELECT s.archive_id, s.pos, s.name, w.unique_name FROM src s JOIN walk w ON w.archive_id = s.archive_id AND w.i = s.i""")
def unique_names(spark: SparkSession, folder: str) -> DataFrame:
    """Archive names made unique, also where a numbered name is there already."""
    # Names that get in each other's way.
    names = ["a.pdf", "a-1.pdf", "a.pdf", "a-2.pdf", "a-1-1.pdf", "a.pdf", "b", "b-1"]
    k = F.col("o_orderkey")
    rows = D.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("archive_id"), k.alias("pos"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int")).alias("name"),
    )
    return naming.unique_names(rows, "archive_id", "pos", "name")


@query("""SELECT 'report-' || CAST(c_nationkey AS VARCHAR) AS report, count(*) AS n_lines,
 CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size_bytes FROM customer GROUP BY c_nationkey""")
def report_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of a folder of report files, and the lines the listed files hold."""
    run = f"{_run_folder(spark, 'listing')}/reports"
    key = F.concat(F.lit("report-"), F.col("c_nationkey").cast("string"))
    D.table(spark, folder, "customer").select(key.alias("report"), "c_name").repartition("report").write.partitionBy(
        "report"
    ).text(run)
    report = F.regexp_extract("path", "report=([^/]+)/", 1).alias("report")
    sizes = list_reports(spark, run, "*.txt").groupBy(report).agg(F.sum("size_bytes").alias("size_bytes"))
    lines = spark.read.text(run).groupBy(F.col("report").alias("_report")).agg(F.count(F.lit(1)).alias("n_lines"))
    return sizes.join(lines, F.col("report") == F.col("_report")).select("report", "n_lines", "size_bytes")


def _page_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages, written as JSON lines of which some are broken, and read back."""
    k = F.col("o_orderkey")
    cells = F.array(
        F.array(F.lit("estat"), F.lit("prioritat")), F.array("o_orderstatus", F.when(k % 13 != 0, F.col("o_orderpriority")))
    )
    page = F.to_json(F.struct(
        F.when(k % 31 != 5, F.col("o_custkey").cast("string")).alias("file_id"),
        F.when(k % 37 != 5, k.cast("int")).alias("page_no"),
        F.when(k % 41 != 5, cells).alias("rows"), F.col("o_totalprice").alias("extra"),
    ))
    path = f"{_run_folder(spark, 'pages')}/lines"
    broken = F.when(k % 29 == 5, F.substring(page, 1, 12)).otherwise(page)
    D.table(spark, folder, "orders").select(broken.alias("value")).write.text(path)
    return read_page_lines(spark, path)


_PAGES_SQL = """WITH p AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS p,
 CASE WHEN o_orderkey % 29 = 5 THEN 'malformed' WHEN o_orderkey % 31 = 5 THEN 'no_file_id'
  WHEN o_orderkey % 37 = 5 THEN 'no_page_no' WHEN o_orderkey % 41 = 5 THEN 'no_rows' END AS reason FROM orders)"""


@query(f"""{_PAGES_SQL} SELECT c AS file_id, CAST(k AS INTEGER) AS page_no, unnest([0, 0, 1, 1])::BIGINT AS row_no,
 unnest([0, 1, 0, 1]) AS col_no, unnest(['estat', 'prioritat', s, p]) AS cell FROM p WHERE reason IS NULL""")
def json_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the page tables that arrive as JSON lines."""
    return _page_lines(spark, folder)[0]


@query(f"""{_PAGES_SQL}, b AS (SELECT CASE WHEN reason IN ('no_page_no', 'no_rows') THEN c END AS file_id, reason
 FROM p WHERE reason IS NOT NULL)
SELECT file_id, count(*) AS n_pages, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM b GROUP BY 1""")
def json_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Reports with lines that are no page, and why."""
    return bad_reports(_page_lines(spark, folder)[1])


# --- retention -------------------------------------------------------------------------

_NOW, _DAYS = dt.datetime(1998, 1, 1), 700


@query(f"""{_RETAINED} SELECT job_id, since, size_bytes FROM waiting
WHERE TIMESTAMP '1998-01-01' - since > INTERVAL 700 DAY""")
def retention_age(spark: SparkSession, folder: str) -> DataFrame:
    """Failed jobs whose artifacts are too old."""
    found = retention.expired_jobs(
        S.jobs(spark, folder), S.artifacts(spark, folder), _NOW, _DAYS
    )
    return found.select("job_id", "since", "size_bytes")


@query(f"""{_RETAINED}, old AS (SELECT * FROM waiting WHERE TIMESTAMP '1998-01-01' - since > INTERVAL 700 DAY),
young AS (SELECT *, sum(size_bytes) OVER (ORDER BY since, id) - size_bytes AS freed FROM waiting
 WHERE job_id NOT IN (SELECT job_id FROM old))
SELECT job_id, since, size_bytes, 'retention>700d' AS reason FROM old
UNION ALL
SELECT job_id, since, size_bytes, 'size-limit>100MB' FROM young
WHERE (SELECT sum(size_bytes) FROM artifacts) - (SELECT coalesce(sum(size_bytes), 0) FROM old) - freed > 100 * 1024 * 1024""")
def retention_size(spark: SparkSession, folder: str) -> DataFrame:
    """The whole plan: by age, then oldest first until the folder fits."""
    return retention.retention_plan(
        S.jobs(spark, folder), S.artifacts(spark, folder), _NOW, _DAYS, 100 * 1024 * 1024
    )


@query(f"""{_RETAINED} SELECT CAST(sum(size_bytes) AS BIGINT) AS retained_bytes FROM artifacts""")
def retained_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes kept for all jobs."""
    return retention.retained_bytes(S.artifacts(spark, folder))


@query(f"""{_RETAINED} SELECT job_id, since, size_bytes FROM waiting ORDER BY since, id LIMIT 1""")
def oldest_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """The failed job the size limit would take first."""
    return retention.oldest_with_artifacts(S.jobs(spark, folder), S.artifacts(spark, folder))


# --- comparison and timings ------------------------------------------------------------

def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as two versions of one sheet per customer: three columns, a header row each."""
    k = F.col("o_orderkey")
    orders = D.table(spark, folder, "orders")

    def side(status, keep):
        rows = orders.filter(keep).select(
            F.col("o_custkey").alias("sheet_id"), (k + 2).alias("row_no"),
            F.posexplode(F.array(k.cast("string"), status, F.col("o_orderpriority"))).alias("c", "value"),
        )
        return rows.select("sheet_id", "row_no", (F.col("c") + 1).alias("col_no"), "value")

    changed = F.when(k % 17 == 0, None).when(k % 19 == 0, "X").otherwise(F.col("o_orderstatus"))
    return side(F.col("o_orderstatus"), F.lit(True)), side(changed, k % 23 != 0)


_DIFF_SQL = """WITH l AS (
 SELECT o_custkey AS sheet_id, o_orderkey + 2 AS row_no, unnest([1, 2, 3]) AS col_no,
  unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS value FROM orders),
r AS (
 SELECT o_custkey AS sheet_id, o_orderkey + 2 AS row_no, unnest([1, 2, 3]) AS col_no,
  unnest([CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'X'
   ELSE o_orderstatus END, o_orderpriority]) AS value FROM orders WHERE o_orderkey % 23 <> 0),
d AS (
 SELECT coalesce(l.sheet_id, r.sheet_id) AS sheet_id, coalesce(l.row_no, r.row_no) AS row_no,
  coalesce(l.col_no, r.col_no) AS col_no, l.value AS left_value, r.value AS right_value
 FROM l FULL JOIN r ON l.sheet_id = r.sheet_id AND l.row_no = r.row_no AND l.col_no = r.col_no
 WHERE l.value IS DISTINCT FROM r.value)"""


@query(f"{_DIFF_SQL} SELECT * FROM d")
def sheet_diff(spark: SparkSession, folder: str) -> DataFrame:
    """All cells in which two versions differ."""
    return diff.differences(*_versions(spark, folder))


@query(f"{_DIFF_SQL} SELECT * FROM d ORDER BY sheet_id, row_no, col_no LIMIT 20")
def first_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 differences."""
    return diff.first_differences(*_versions(spark, folder))


@query(f"""{_DIFF_SQL}, a AS (SELECT sheet_id, max(row_no) AS rows, max(col_no) AS cols FROM l GROUP BY 1),
b AS (SELECT sheet_id, max(row_no) AS rows, max(col_no) AS cols FROM r GROUP BY 1),
n AS (SELECT sheet_id, count(*) AS n FROM d GROUP BY 1)
SELECT a.sheet_id, a.rows AS left_rows, a.cols AS left_cols, b.rows AS right_rows, b.cols AS right_cols,
 a.rows IS NOT DISTINCT FROM b.rows AND a.cols IS NOT DISTINCT FROM b.cols AS same_dimensions,
 a.cols IS NOT DISTINCT FROM b.cols AS same_headers, coalesce(n.n, 0) AS n_diffs
FROM a LEFT JOIN b ON b.sheet_id = a.sheet_id LEFT JOIN n ON n.sheet_id = a.sheet_id""")
def diff_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Per sheet: same size, same headers, number of differences."""
    return diff.compare_sheets(*_versions(spark, folder))


def _titled(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Both versions with a header row and a title; some headers and titles are changed."""
    left, right = _versions(spark, folder)
    n = F.col("sheet_id")
    sheets = left.select("sheet_id").distinct()

    def heads(last) -> DataFrame:
        names = F.array(F.lit("acta"), F.lit("estat"), last)
        rows = sheets.select("sheet_id", F.lit(1).cast("long").alias("row_no"), F.posexplode(names).alias("c", "value"))
        return rows.select("sheet_id", "row_no", (F.col("c") + 1).alias("col_no"), "value")

    title = F.concat(F.lit("full "), n.cast("string"))
    changed = F.when(n % 7 == 0, "prior").otherwise("prioritat")
    return [
        left.unionByName(heads(F.lit("prioritat"))), right.unionByName(heads(changed)),
        sheets.select("sheet_id", title.alias("title")),
        sheets.filter(n % 11 != 0).select("sheet_id", F.when(n % 5 == 0, "nou").otherwise(title).alias("title")),
    ]


_HEADS = """SELECT DISTINCT o_custkey AS sheet_id, CAST(1 AS BIGINT) AS row_no, unnest([1, 2, 3]) AS col_no,
 unnest(['acta', 'estat', {last}]) AS value FROM orders"""


@query(f"""{_DIFF_SQL}, lh AS (SELECT * FROM l UNION ALL {_HEADS.format(last="'prioritat'")}),
rh AS (SELECT * FROM r UNION ALL {_HEADS.format(last="CASE WHEN o_custkey % 7 = 0 THEN 'prior' ELSE 'prioritat' END")}),
a AS (SELECT sheet_id, max(row_no) AS rows, max(col_no) AS cols,
 list(value ORDER BY col_no) FILTER (WHERE row_no = 1) AS heads FROM lh GROUP BY 1),
b AS (SELECT sheet_id, max(row_no) AS rows, max(col_no) AS cols,
 list(value ORDER BY col_no) FILTER (WHERE row_no = 1) AS heads FROM rh GROUP BY 1),
n AS (SELECT sheet_id, count(*) AS n FROM d GROUP BY 1),
t AS (SELECT sheet_id, 'full ' || CAST(sheet_id AS VARCHAR) AS left_title, CASE WHEN sheet_id % 11 = 0 THEN NULL
 WHEN sheet_id % 5 = 0 THEN 'nou' ELSE 'full ' || CAST(sheet_id AS VARCHAR) END AS right_title FROM a)
SELECT t.*, a.rows AS left_rows, a.cols AS left_cols, b.rows AS right_rows, b.cols AS right_cols,
 a.rows = b.rows AND a.cols = b.cols AS same_dimensions, a.heads = b.heads AS same_headers,
 left_title IS NOT DISTINCT FROM right_title AS same_sheet_title,
 coalesce(n.n, 0) + CASE WHEN a.heads = b.heads THEN 0 ELSE 1 END AS n_diffs
FROM t JOIN a ON a.sheet_id = t.sheet_id JOIN b ON b.sheet_id = t.sheet_id LEFT JOIN n ON n.sheet_id = t.sheet_id""")
def diff_titled(spark: SparkSession, folder: str) -> DataFrame:
    """Per sheet: same title, size and header row, number of differences."""
    return diff.compare_titled(*_titled(spark, folder))


def _timings(spark: SparkSession, folder: str) -> DataFrame:
    """Timing lines made of the events, read back; other log lines lie in between."""
    n = F.col("event_id")
    events = D.table(spark, folder, "events").select(
        F.col("event_type").alias("label"), ((n % 97).cast("double") / 8).alias("total_seconds"),
        F.array(
            F.struct(F.lit("read").alias("name"), ((n % 7).cast("double") / 4).alias("seconds")),
            F.struct(F.lit("write").alias("name"), ((n % 5).cast("double") / 2).alias("seconds")),
        ).alias("stages"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("context"),
    )
    noise = D.table(spark, folder, "events").select(F.col("props").alias("value"))
    return timing.parse_timings(timing.format_timings(events).unionByName(noise))


@query("""SELECT event_type AS label, count(*) AS runs, round(avg(CAST(event_id % 97 AS DOUBLE) / 8), 6) AS mean_seconds,
 min(CAST(event_id % 97 AS DOUBLE) / 8) AS min_seconds, max(CAST(event_id % 97 AS DOUBLE) / 8) AS max_seconds
FROM events GROUP BY 1""")
def timing_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, minimum and maximum duration per label, from log lines."""
    return timing.run_statistics(_timings(spark, folder))


@query("""SELECT event_type AS label, unnest(['read', 'write']) AS stage, count(*) AS runs,
 unnest([sum(CAST(event_id % 7 AS DOUBLE) / 4), sum(CAST(event_id % 5 AS DOUBLE) / 2)]) AS seconds
FROM events GROUP BY event_type""")
def stage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds per label and stage, from log lines."""
    return timing.stage_totals(_timings(spark, folder))
