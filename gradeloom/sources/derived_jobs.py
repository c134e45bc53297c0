"""Audit inputs derived from the star-schema tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import table


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One conversion job per order (columns of ``schemas.JOBS`` that the queries use)."""
    k = F.col("o_orderkey")
    failed, done = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    base = F.concat(F.lit("/failed/job-"), k.cast("string"))
    kinds = F.array(F.lit("pdf"), F.lit("zip"), F.lit("pdf_batch"))
    metadata = (
        F.when(k % 6 == 0, F.concat(
            F.lit('{"failed_source_path": "'), base, F.lit('/source.pdf", "failure_log_path": "'),
            base, F.lit('/failure.log"}')))
        .when(k % 6 == 1, "[1, 2]").when(k % 6 == 2, "").when(k % 6 == 3, "not json")
        .when(k % 6 == 4, '{"failed_source_path": null, "artifacts_deleted_at": "2024-01-01T00:00:00+00:00"}')
    )
    return table(spark, folder, "orders").select(
        k.alias("id"),
        F.concat(F.lit("job-"), k.cast("string")).alias("job_id"),
        F.element_at(kinds, (k % 3 + 1).cast("int")).alias("request_type"),
        F.floor("o_totalprice").alias("source_size_bytes"),
        F.when(failed, "error").when(done, "success").otherwise("processing").alias("status"),
        # Some jobs name a folder that no longer exists.
        F.when(failed & (k % 4 != 1), F.when(k % 5 == 3, F.concat(F.lit("/moved"), base)).otherwise(base))
        .alias("debug_path"),
        metadata.alias("metadata_json"),
        F.when(k % 5 != 0, "processing").alias("stage"),
        F.when(k % 5 > 1, F.concat(F.lit("pas "), (k % 9).cast("string"))).alias("progress_message"),
        F.when(k % 11 != 10, (k % 11).cast("int")).alias("progress_current"),
        F.when(k % 7 != 1, (k % 7).cast("int")).alias("progress_total"),
        F.col("o_orderdate").alias("created_at"),
        F.when((failed | done) & (k % 10 != 0),
               F.col("o_orderdate") + F.make_dt_interval(hours=(k % 48).cast("int"))).alias("completed_at"),
    )


JOBS_SQL = """jobs AS (
 SELECT o_orderkey AS id, 'job-' || CAST(o_orderkey AS VARCHAR) AS job_id,
  (['pdf', 'zip', 'pdf_batch'])[CAST(o_orderkey % 3 + 1 AS INTEGER)] AS request_type,
  CAST(floor(o_totalprice) AS BIGINT) AS source_size_bytes,
  CASE o_orderstatus WHEN 'O' THEN 'error' WHEN 'F' THEN 'success' ELSE 'processing' END AS status,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 <> 1
   THEN CASE WHEN o_orderkey % 5 = 3 THEN '/moved' ELSE '' END || '/failed/job-' || CAST(o_orderkey AS VARCHAR) END AS debug_path,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'processing' END AS stage,
  CASE WHEN o_orderkey % 5 > 1 THEN 'pas ' || CAST(o_orderkey % 9 AS VARCHAR) END AS progress_message,
  CASE WHEN o_orderkey % 11 <> 10 THEN CAST(o_orderkey % 11 AS INTEGER) END AS progress_current,
  CASE WHEN o_orderkey % 7 <> 1 THEN CAST(o_orderkey % 7 AS INTEGER) END AS progress_total,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus IN ('O', 'F') AND o_orderkey % 10 <> 0
   THEN o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) END AS completed_at
 FROM orders)"""


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Retained files: one per line item, in the folder of its order (``schemas.ARTIFACTS``)."""
    name = (
        F.when(F.col("l_linenumber") == 1, "source.pdf").when(F.col("l_linenumber") == 2, "failure.log")
        .otherwise(F.concat(F.lit("output/"), F.col("l_partkey").cast("string"), F.lit(".xlsx")))
    )
    job = F.concat(F.lit("job-"), F.col("l_orderkey").cast("string"))
    return table(spark, folder, "lineitem").select(
        job.alias("job_id"), F.concat(F.lit("/failed/"), job, F.lit("/"), name).alias("path"),
        F.floor("l_extendedprice").alias("size_bytes"),
    )


ARTIFACTS_SQL = """artifacts AS (
 SELECT l_orderkey AS id, 'job-' || CAST(l_orderkey AS VARCHAR) AS job_id, l_linenumber AS n,
        CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes
 FROM lineitem),
flags AS (
 SELECT j.job_id, coalesce(j.debug_path LIKE '/failed/%', FALSE) AND bool_or(a.n IS NOT NULL) AS has_debug_path,
  j.id % 6 = 0 AND bool_or(coalesce(a.n = 1, FALSE)) AS has_failed_source,
  j.id % 6 = 0 AND bool_or(coalesce(a.n = 2, FALSE)) AS has_failure_log
 FROM jobs j LEFT JOIN artifacts a ON a.id = j.id GROUP BY j.job_id, j.id, j.debug_path),
waiting AS (
 SELECT j.job_id, j.id, coalesce(j.completed_at, j.created_at) AS since,
  (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM artifacts a WHERE a.id = j.id) AS size_bytes
 FROM jobs j JOIN flags f ON f.job_id = j.job_id
 WHERE j.status = 'error' AND (f.has_debug_path OR f.has_failed_source OR f.has_failure_log))"""


def batch_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One batch per customer, with the columns the incident texts need."""
    k = F.col("c_custkey")
    kinds = F.array(F.lit("pdf"), F.lit("zip"), F.lit("pdf_batch"))
    key = k.cast("string")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("batch-"), key).alias("job_id"),
        F.element_at(kinds, (k % 3 + 1).cast("int")).alias("request_type"),
        F.concat(F.lit("lot-"), key, F.lit(".zip")).alias("source_name"),
        F.concat(F.lit("error "), (k % 7).cast("string")).alias("error_message"),
        F.concat(F.lit("/failed/batch-"), key).alias("debug_path"),
    )


def batch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the batches: one per order, with errors of several kinds."""
    k = F.col("o_orderkey")
    # Error texts as the conversion steps raise them.
    texts = [
        "expected string or bytes-like object, got 'float'", "No objects to concatenate",
        "list index out of range", "The ZIP file does not contain any PDF files.", "'code'", "",
    ]
    failed = (F.col("o_orderstatus") == "O") | (F.col("o_custkey") % 4 == 0)
    error = F.element_at(F.array(*[F.lit(t) for t in texts]), (k % len(texts) + 1).cast("int"))
    name = F.concat(F.lit("acta-"), k.cast("string"))
    return table(spark, folder, "orders").select(
        k.alias("id"),
        F.concat(F.lit("batch-"), F.col("o_custkey").cast("string")).alias("job_id"),
        F.concat(name, F.lit(".pdf")).alias("source_name"),
        F.when(~failed, F.concat(name, F.lit(".xlsx"))).alias("output_name"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, error).alias("error_message"),
        F.col("o_orderdate").alias("created_at"),
    )


BATCH_SQL = """files AS (
 SELECT o_orderkey AS id, 'batch-' || CAST(o_custkey AS VARCHAR) AS job_id,
  'acta-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS source_name,
  CASE WHEN NOT failed THEN 'acta-' || CAST(o_orderkey AS VARCHAR) || '.xlsx' END AS output_name,
  CASE WHEN failed THEN 'error' ELSE 'success' END AS status,
  CASE WHEN failed THEN (['expected string or bytes-like object, got ''float''', 'No objects to concatenate',
   'list index out of range', 'The ZIP file does not contain any PDF files.', '''code''', ''])
   [CAST(o_orderkey % 6 + 1 AS INTEGER)] END AS error_message,
  CASE WHEN failed THEN CASE o_orderkey % 6
   WHEN 0 THEN 'El fitxer no té l''estructura esperada d''una acta.'
   WHEN 1 THEN 'No s''han pogut extreure les taules necessàries del PDF.'
   WHEN 2 THEN 'No s''ha pogut llegir correctament la primera pàgina del PDF.'
   WHEN 3 THEN 'El fitxer comprimit no conté cap PDF vàlid.'
   ELSE 'No s''ha pogut convertir aquest fitxer perquè no té el format esperat o hi ha hagut un error durant el procés.'
   END END AS public_message, created_at
 FROM (SELECT *, o_orderstatus = 'O' OR o_custkey % 4 = 0 AS failed, o_orderdate AS created_at FROM orders)),
batches AS (
 SELECT 'batch-' || CAST(c_custkey AS VARCHAR) AS job_id,
  (['pdf', 'zip', 'pdf_batch'])[CAST(c_custkey % 3 + 1 AS INTEGER)] AS request_type,
  'lot-' || CAST(c_custkey AS VARCHAR) || '.zip' AS source_name,
  'error ' || CAST(c_custkey % 7 AS VARCHAR) AS error_message,
  '/failed/batch-' || CAST(c_custkey AS VARCHAR) AS debug_path FROM customer),
outcomes AS (
 SELECT job_id, count(*) FILTER (WHERE status = 'success') AS n_success,
  count(*) FILTER (WHERE status = 'error') AS n_failed,
  array_to_string(list_slice(array_agg(source_name ORDER BY id) FILTER (WHERE status = 'error'), 1, 3), ', ')
   || CASE WHEN count(*) FILTER (WHERE status = 'error') > 3 THEN ', ...' ELSE '' END AS failed_names
 FROM files GROUP BY job_id)"""


def lifecycle(events: DataFrame) -> DataFrame:
    """The event table as job lifecycle events (``schemas.JOB_EVENTS``), batch or stream."""
    n, kind = F.col("event_id"), F.col("event_type")
    event = (
        F.when(kind == "signup", "created").when(kind == "click", "started")
        .when(kind == "purchase", "success").when(kind == "error", "error")
        .when(n % 3 == 0, "artifact").when(n % 3 == 1, "source_count").otherwise("progress")
    )
    num = n.cast("string")

    def on(value, *names):
        return F.when(F.col("event").isin(*names), value)

    base = events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        n.alias("seq"), event.alias("event"), "ts", "event_id", "props",
    )
    return base.select(
        "job_id", "seq", "event", "ts",
        on(F.when(n % 2 == 0, "pdf").otherwise("zip"), "created").alias("request_type"),
        on(F.concat(F.lit("upload-"), num), "created").alias("source_name"),
        on(n * 10, "created").alias("source_size_bytes"),
        on((n % 9).cast("int"), "created", "source_count").alias("source_file_count"),
        on(F.lit("10.0.0.1"), "created").alias("remote_addr"),
        on(F.when(n % 2 == 0, "processing").otherwise("compressing"), "progress").alias("stage"),
        on(F.concat(F.lit("pas "), num), "progress").alias("progress_message"),
        on((n % 5).cast("int"), "progress").alias("progress_current"),
        on(F.lit(5), "progress").alias("progress_total"),
        on(F.when(n % 4 != 0, F.col("props")), "progress", "error", "artifact").alias("metadata_json"),
        on(F.concat(F.lit("out-"), num), "success").alias("returned_name"),
        on((n % 6).cast("int"), "success").alias("returned_file_count"),
        on(F.concat(F.lit("failure "), num), "error").alias("error_message"),
        F.when(F.col("event") == "error", F.concat(F.lit("/failed/"), num))
        .when((F.col("event") == "artifact") & (n % 2 == 0), F.concat(F.lit("/moved/"), num))
        .alias("debug_path"),
    )


def _newest(value: str, *events: str) -> str:
    names = ", ".join(f"'{e}'" for e in events)
    return f"(array_agg({value} ORDER BY seq DESC) FILTER (WHERE event IN ({names})))[1]"


LIFECYCLE_SQL = f"""WITH ev AS (
 SELECT 'job-' || CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts, props, CAST(event_id AS VARCHAR) AS num,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'success'
   WHEN 'error' THEN 'error' ELSE (['artifact', 'source_count', 'progress'])[CAST(event_id % 3 + 1 AS INTEGER)] END AS event
 FROM events)
SELECT job_id,
 {_newest("CASE WHEN seq % 2 = 0 THEN 'pdf' ELSE 'zip' END", 'created')} AS request_type,
 {_newest("'upload-' || num", 'created')} AS source_name,
 {_newest("seq * 10", 'created')} AS source_size_bytes,
 {_newest("CAST(seq % 9 AS INTEGER)", 'created', 'source_count')} AS source_file_count,
 {_newest("'10.0.0.1'", 'created')} AS remote_addr,
 {_newest("CASE event WHEN 'created' THEN 'received' WHEN 'started' THEN 'processing' ELSE event END", 'created', 'started', 'success', 'error')} AS status,
 {_newest("'out-' || num", 'success')} AS returned_name,
 {_newest("CAST(seq % 6 AS INTEGER)", 'success')} AS returned_file_count,
 {_newest("'failure ' || num", 'error')} AS error_message,
 {_newest("CASE WHEN event = 'error' THEN '/failed/' || num WHEN seq % 2 = 0 THEN '/moved/' || num END", 'error', 'artifact')} AS debug_path,
 {_newest("CASE WHEN seq % 4 = 0 THEN '{}' ELSE props END", 'progress', 'error', 'artifact')} AS metadata_json,
 {_newest("CASE WHEN seq % 2 = 0 THEN 'processing' ELSE 'compressing' END", 'progress')} AS stage,
 {_newest("'pas ' || num", 'progress')} AS progress_message,
 coalesce({_newest("CAST(seq % 5 AS INTEGER)", 'progress')}, 0) AS progress_current,
 coalesce({_newest("5", 'progress')}, 1) AS progress_total,
 {_newest("ts", 'created')} AS created_at, {_newest("ts", 'started')} AS started_at,
 {_newest("ts", 'success', 'error')} AS completed_at, {_newest("ts", 'success')} AS returned_at,
 arg_max(ts, seq) AS updated_at
FROM ev GROUP BY job_id"""
