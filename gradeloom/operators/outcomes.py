"""What became of each file and batch, and the texts that tell about failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions.text import single_line
from .joins import join_on, lookup
from .ordered import block_of, ordered_text

# Low-level error texts per reason, and the public text for each.
ERRORS = {
    "no_tables": "No objects to concatenate",
    "null_header": "expected string or bytes-like object",
    "no_name_column": "",
    "no_outcome_codes": "'code'",
    "duplicate_grades": "Index contains duplicate entries, cannot reshape",
}
PUBLIC_TEXTS = {
    "expected string or bytes-like object": "El fitxer no té l'estructura esperada d'una acta{system}.",
    "no objects to concatenate": "No s'han pogut extreure les taules necessàries del PDF.",
    "list index out of range": "No s'ha pogut llegir correctament la primera pàgina del PDF.",
    "the zip file does not contain any pdf files": "El fitxer comprimit no conté cap PDF vàlid.",
}
OTHER_TEXT = (
    "No s'ha pogut convertir aquest fitxer perquè no té el format esperat o hi ha hagut un "
    "error durant el procés."
)
NO_FILE_CONVERTED = "No s'ha pogut convertir cap fitxer del lot."
FAILED_NAMES = " Fitxers amb error: %s."
PARTIAL_HEAD = "Hi ha hagut una conversio parcial amb incidencies."
BATCH_HEAD = "Ha fallat la conversio completa d'un lot."
SINGLE_HEAD = "Ha fallat la conversio d'un fitxer."
CONVERTED_ONE, CONVERTED_MANY = "fitxer convertit correctament", "fitxers convertits correctament"
FAILED_ONE, FAILED_MANY = "fitxer amb error", "fitxers amb error"
JOB_LINE, TYPE_LINE, FILE_LINE = "Job ID: ", "Tipus de peticio: ", "Fitxer: "
RESULT_LINE, ERROR_LINE, DEBUG_LINE = "Resultat: ", "Error principal: ", "Debug path: "
FAILED_HEAD = "Fitxers amb error:\n"
PARTIAL_SUBJECT = "Partial conversion failure for "
SINGLE_SUBJECT = "Conversion failed for "
BATCH_SUBJECT = "Batch conversion failed for "


def public_error(error: Column, system: str = "") -> Column:
    """Public text for a low-level error: first match wins, any case.

    ``system`` names the school system in the first text, for instance ``" de X"``.
    """
    low = F.lower(F.coalesce(error, F.lit("")))
    choice = None
    for part, text in PUBLIC_TEXTS.items():
        text = text.format(system=system)
        hit = F.contains(low, F.lit(part))
        choice = F.when(hit, text) if choice is None else choice.when(hit, text)
    return choice.otherwise(OTHER_TEXT)


def header_faults(files: DataFrame, heads: DataFrame) -> DataFrame:
    """``files`` with the ``reason`` that their header cells already give against them, or null.

    ``heads`` holds ``(file_id, header)``. A file without header cells has no table; a table
    of headers alone is one, its lack of records shows later.
    """
    named = F.contains(F.lower(single_line(F.col("header"))), F.lit(G.NAME_KEYWORD))
    tables = heads.groupBy("file_id").agg(
        F.bool_or(F.col("header").isNull()).alias("_null_header"),
        F.bool_or(F.coalesce(named, F.lit(False))).alias("_named"),
    )
    return join_on(files, tables, ["file_id"], "left").select(
        *files.columns,
        F.when(F.col("_named").isNull(), "no_tables")
        .when(F.col("_null_header"), "null_header")
        .when(~F.col("_named"), "no_name_column").alias("reason"),
    )


def file_outcomes(faults: DataFrame, records: DataFrame) -> DataFrame:
    """One outcome per file: ``status, reason, error_message, public_message`` beside its columns.

    ``faults`` come from :func:`header_faults`; ``records`` from the files without any.
    """
    codes = records.groupBy("file_id", "student", "code").agg(
        F.bool_or(F.col("kind") == "RA").alias("_ra"), (F.count(F.lit(1)) > 1).alias("_twice")
    )
    found = codes.groupBy("file_id").agg(
        F.bool_or("_ra").alias("_ra"), F.bool_or("_twice").alias("_twice")
    )
    reason = F.coalesce(
        F.col("reason"),
        F.when(~F.coalesce("_ra", F.lit(False)), "no_outcome_codes").when(F.col("_twice"), "duplicate_grades"),
    )
    rest = [c for c in faults.columns if c != "reason"]
    joined = join_on(faults, found, ["file_id"], "left").select(*rest, reason.alias("reason"))
    message = None
    for name, text in ERRORS.items():
        hit = F.col("reason") == name
        message = F.when(hit, text) if message is None else message.when(hit, text)
    return joined.select(
        *rest,
        F.when(F.col("reason").isNull(), "success").otherwise("error").alias("status"),
        "reason",
        message.alias("error_message"),
        F.when(F.col("reason").isNotNull(), public_error(message)).alias("public_message"),
    )


def classify_files(files: DataFrame, cells: DataFrame, records: DataFrame) -> DataFrame:
    """One outcome per file: ``(file_id, status, reason, error_message, public_message)``.

    ``cells`` carry headers, ``records`` come from the same cells. A bad file becomes a row;
    the others go on. Reasons are checked in the order of the work.
    """
    return file_outcomes(header_faults(files.select("file_id"), cells), records)


def audit_file_rows(files: DataFrame, jobs: DataFrame, now: Column, order: str = "id") -> DataFrame:
    """Rows for the audit trail: those of the files, and one more for each job that failed whole.

    That row is named after the job and holds its error. A failed single report has none, as
    its file's row tells the same.
    """
    whole = batch_outcomes(files, order, jobs).filter(
        F.col("file_rows") > F.col("n_success") + F.col("n_failed")
    )
    named = jobs.select("job_id", "source_name")
    extra = whole.select("job_id", "error_message").join(named, ["job_id"]).select(
        F.lit(None).cast("long").alias("id"), "job_id", "source_name",
        F.lit(None).cast("string").alias("output_name"), F.lit("error").alias("status"),
        "error_message", now.alias("created_at"),
    )
    return files.select(*extra.columns).unionByName(extra)


def first_failed_names(files: DataFrame, order: str = "id", limit: int = 3) -> DataFrame:
    """Per job the first failed names, with ``, ...`` when there are more.

    The first names of each block of ``order`` are picked before the shuffle by job.
    """
    failed = files.filter(F.col("status") == "error")

    def firsts(rows: Column) -> Column:
        return F.slice(F.sort_array(rows), 1, limit)

    blocks = failed.groupBy("job_id", block_of(order).alias("_block")).agg(
        F.count(F.lit(1)).alias("_n"),
        firsts(F.collect_list(F.struct(order, "source_name"))).alias("_first"),
    )
    picked = blocks.groupBy("job_id").agg(
        F.sum("_n").alias("n_failed"), firsts(F.flatten(F.collect_list("_first"))).alias("_first")
    )
    names = F.array_join(F.transform("_first", lambda r: r["source_name"]), ", ")
    more = F.when(F.col("n_failed") > limit, ", ...").otherwise("")
    return picked.select("job_id", "n_failed", F.concat(names, more).alias("failed_names"))


def batch_outcomes(files: DataFrame, order: str = "id", jobs: DataFrame | None = None) -> DataFrame:
    """Per job: counts, ``success`` / ``partial`` / ``error``, job status and error text.

    One converted file makes the job a success. Without any, the job fails and its audit
    trail gets one more failed row, named after the job; ``file_rows`` counts it.

    With ``jobs`` (``job_id, request_type, error_message``) a failed single report (type
    ``pdf``) keeps the raw error of its file and gets no further row, and a job with an
    error but without any file row (an archive without reports, say) has an outcome too.
    """
    failed_text = F.struct(F.col(order), F.col("error_message").alias("text"))
    counts = files.groupBy("job_id").agg(
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "error").alias("n_failed"),
        F.min(F.when(F.col("status") == "error", failed_text))["text"].alias("_raw"),
    )
    names = first_failed_names(files, order).select("job_id", "failed_names")
    joined = counts.join(names, ["job_id"], "left")
    if jobs is None:
        joined = joined.withColumns({"_single": F.lit(False), "_own": F.lit(None).cast("string")})
    else:
        told = jobs.select(
            "job_id", F.coalesce(F.col("request_type") == "pdf", F.lit(False)).alias("_single"),
            F.col("error_message").alias("_own"),
        )
        joined = told.join(joined.hint("merge"), ["job_id"], "left").filter(
            F.col("n_success").isNotNull() | F.col("_own").isNotNull()
        ).na.fill(0, ["n_success", "n_failed"])
    none = F.col("n_success") == 0
    empty = none & (F.col("n_failed") == 0)
    text = F.concat(
        F.lit(NO_FILE_CONVERTED),
        F.coalesce(F.format_string(FAILED_NAMES, F.nullif("failed_names", F.lit(""))), F.lit("")),
    )
    return joined.select(
        "job_id", "n_success", "n_failed",
        F.when(none, "error").when(F.col("n_failed") > 0, "partial").otherwise("success").alias("outcome"),
        F.when(none, "error").otherwise("success").alias("status"),
        F.when(empty & F.col("_own").isNotNull(), F.col("_own"))
        .when(none & F.col("_single"), F.col("_raw")).when(none, text).alias("error_message"),
        (F.col("n_success") + F.col("n_failed") + (none & (~F.col("_single") | empty)).cast("long"))
        .alias("file_rows"),
    )


def _count_label(count: Column, one: str, many: str) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, one).otherwise(many))


def incident_texts(
    jobs: DataFrame, files: DataFrame, subject_prefix: str = "", order: str = "id", system: str = ""
) -> DataFrame:
    """Subject and body of the report on each job that had a failure.

    ``jobs`` holds ``(job_id, request_type, source_name, error_message, debug_path)``. A job
    that failed before it had any file row gets a report without file details.
    """
    failed = files.filter(F.col("status") == "error")
    debug = jobs.select("job_id", "debug_path")
    lines = lookup(failed, debug, ["job_id"], order).withColumn("_line", F.concat(
        F.lit(f"- {FILE_LINE}"), "source_name",
        F.lit(f"\n  {ERROR_LINE}"), public_error(F.col("error_message"), system),
        F.lit(f"\n  {DEBUG_LINE}"), F.coalesce("debug_path", F.lit("None")),
    ))
    blocks = ordered_text(lines, ["job_id"], order, "_line", "_blocks", separator="\n\n")
    done = batch_outcomes(files, order, jobs).filter(F.col("outcome") != "success")
    # One row per job on each side: neither is small because its files are.
    told = jobs.join(done.drop("status", "error_message").hint("merge"), ["job_id"])
    told = told.join(blocks.hint("merge"), ["job_id"], "left")
    head = F.concat(
        F.lit(f"\n\n{JOB_LINE}"), "job_id", F.lit(f"\n{TYPE_LINE}"), "request_type", F.lit("\n")
    )
    failed_label = _count_label(F.col("n_failed"), FAILED_ONE, FAILED_MANY)
    details = F.coalesce(F.concat(F.lit(FAILED_HEAD), "_blocks", F.lit("\n")), F.lit(""))
    main = F.concat(F.lit(ERROR_LINE), F.coalesce("error_message", F.lit("None")), F.lit("\n"))
    single = F.concat(
        F.lit(SINGLE_HEAD), head, F.lit(FILE_LINE), "source_name", F.lit("\n"), main,
        F.lit(DEBUG_LINE), F.coalesce("debug_path", F.lit("None")), F.lit("\n"),
    )
    partial = F.concat(
        F.lit(PARTIAL_HEAD), head, F.lit(RESULT_LINE),
        _count_label(F.col("n_success"), CONVERTED_ONE, CONVERTED_MANY),
        F.lit(" i "), failed_label, F.lit(".\n"), details,
    )
    whole = F.concat(
        F.lit(BATCH_HEAD), head, F.lit(f"{RESULT_LINE}0 {CONVERTED_MANY} i "), failed_label,
        F.lit(".\n"), main, details,
    )
    is_partial = F.col("outcome") == "partial"
    is_single = F.col("request_type") == "pdf"
    subject = (
        F.when(is_partial, PARTIAL_SUBJECT)
        .when(is_single, SINGLE_SUBJECT)
        .otherwise(BATCH_SUBJECT)
    )
    return told.select(
        "job_id",
        F.concat(F.lit(subject_prefix), subject, "source_name").alias("subject"),
        F.when(is_partial, partial).when(is_single, single).otherwise(whole).alias("body"),
    )
