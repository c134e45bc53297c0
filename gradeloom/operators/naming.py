"""Uploads, archive members and unique output names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_name, is_blank, stem, suffix
from ..session import cut
from .joins import join_on, lookup
from .ordered import scan, with_row_number

# Rejection texts, accepted suffixes and the name of a batch upload.
NO_FILES = "Cal carregar almenys un fitxer PDF o ZIP."
BAD_SUFFIX = "Només s'admeten fitxers PDF i ZIP."
MIXED_BATCH = "Si carregues diversos fitxers alhora, tots han de ser PDF."
ACCEPTED_SUFFIXES = (".pdf", ".zip")
BATCH_NAME = "selected_files-converted.zip"
SUMMARY_PREFIX = "qualificacions_MP-"
CONTENT_TYPES = {".zip": "application/zip", ".pdf": "application/pdf"}
SHEET_CONTENT_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def select_members(members: DataFrame) -> DataFrame:
    """Report files of each archive: no folders, no dot-names, suffix ``.pdf`` in any case."""
    name = file_name(F.col("path"))
    return members.withColumn("name", name).filter(
        ~F.col("is_dir") & ~F.startswith("name", F.lit("."))
        & (F.lower(suffix(F.col("name"))) == ".pdf")
    )


def skip_lock_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Leave out the ``~$`` files a spreadsheet program keeps while a sheet is open."""
    return files.filter(~F.startswith(file_name(F.col(path)), F.lit("~$")))


def check_uploads(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Per request: ``request_type`` and ``source_name``, or the first reason to reject it."""
    end = F.lower(suffix(F.col("name")))
    counts = uploads.filter(~is_blank(F.col("name"))).groupBy("request_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_files"),
        F.count_if(~end.isin(*ACCEPTED_SUFFIXES)).alias("_bad"),
        F.count_if(end == ".zip").alias("_zip"),
        F.min("name").alias("_name"),
    )
    reason = (
        F.when(F.coalesce("n_files", F.lit(0)) == 0, NO_FILES)
        .when(F.col("_bad") > 0, BAD_SUFFIX)
        .when((F.col("n_files") > 1) & (F.col("_zip") > 0), MIXED_BATCH)
    )
    single = F.when(F.col("_zip") > 0, "zip").otherwise("pdf")
    batch = F.col("n_files") > 1
    return requests.join(counts, ["request_id"], "left").withColumn("reject_reason", reason).select(
        "request_id",
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        "reject_reason",
        F.when(F.col("reject_reason").isNull(), F.when(batch, "pdf_batch").otherwise(single))
        .alias("request_type"),
        F.when(F.col("reject_reason").isNull(), F.when(batch, BATCH_NAME).otherwise(F.col("_name")))
        .alias("source_name"),
    )


def dedupe_uploads(uploads: DataFrame) -> DataFrame:
    """Files picked twice in one request (same name, size and time) are kept once, the first."""
    same = ["request_id", "name", "size_bytes", "last_modified"]
    return uploads.groupBy(*same).agg(F.min("pos").alias("pos"))


def content_type(name):
    """Download content type of an output file name."""
    end = F.lower(suffix(name))
    choice = None
    for ext, kind in CONTENT_TYPES.items():
        choice = F.when(end == ext, kind) if choice is None else choice.when(end == ext, kind)
    return choice.otherwise(SHEET_CONTENT_TYPE)


# A numbered stem: what stands before the number, and the number; and all numbers at the end.
_NUMBERED, _NUMBERS = r"^(?s)(.*)-([1-9][0-9]*)$", r"(?s)(-[1-9][0-9]*)+$"
#: Literals decided together, more where one root name of a key has more.
DECIDED_TOGETHER = 20_000


def unique_names(df: DataFrame, key: str, pos: str, name: str, out: str = "unique_name") -> DataFrame:
    """Make names unique per ``key`` in ``pos`` order: a taken name gets ``-1``, ``-2``, ...

    ``pos`` is an integer unique within ``key``. A repeat takes the smallest number whose
    name is still free. Only the literal name ``stem-k`` can be in the way of ``stem``'s
    k-th number, so the work splits by name: repeats are numbered per name, and a literal
    ``stem-k`` that meets repeats of ``stem`` either came first (its number is skipped) or
    finds its name taken. That is decided once per literal, from the count of repeats
    before it, parent names first. Names end in a suffix or at least not in a dot.

    The literals below one name (``a-1``, ``a-2``, ``a-1-1``, ... next to ``a``) of one key are
    decided in one task, a few bytes each; small such families share a task group. Rows of a
    name may be any number.
    """
    # In a struct a null key is a value like any other.
    rows = df.select("*", F.struct(F.col(key)).alias("_key"), F.col(name).alias("_name"))
    numbered = with_row_number(rows, ["_key", "_name"], [F.col(pos)], "_n")
    decided = _decided_literals(numbered, pos)
    kept = decided.filter("_kept is not null").select("_key", "_name", "_kept")
    rows = lookup(numbered, kept, ["_key", "_name"], pos, "left", written=True)
    # Repeat number: the first row of a name is a repeat only if the name was taken before.
    repeat = F.col("_n") - F.when(F.coalesce("_kept", F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("_repeat", repeat).drop("_n", "_kept")
    # Skipped numbers below a repeat's are counted along the numbers; a skip comes before the
    # repeat of its own number.
    skips = decided.filter("_skip is not null").groupBy("_key", "_name", "_skip").agg(
        F.count(F.lit(1)).alias("_skips")
    )
    skipping = cut(skips.select("_key", "_name").distinct())
    plain = lookup(rows, skipping, ["_key", "_name"], pos, "left_anti", written=True).withColumn("_passed", F.lit(0).cast("long"))
    along = lookup(rows, skipping, ["_key", "_name"], pos, "left_semi", written=True)
    along = along.withColumn("_at", 2 * F.col("_repeat"))
    along = along.unionByName(
        skips.withColumn("_at", 2 * F.col("_skip") - 1).drop("_skip"), allowMissingColumns=True
    )
    counted = scan(along, ["_key", "_name"], "_at", total={"_passed": F.col("_skips")})
    counted = counted.filter("_skips is null").drop("_skips", "_at")
    numbered_name = F.concat(
        stem(F.col("_name")), F.lit("-"), (F.col("_repeat") + F.col("_passed")).cast("string"),
        suffix(F.col("_name")),
    )
    return plain.unionByName(counted).withColumn(
        out, F.when(F.col("_repeat") == 0, F.col("_name")).otherwise(numbered_name)
    ).drop("_key", "_name", "_repeat", "_passed")


def _decide():
    """Decides the literals of whole root names: which keep their names, what their parents skip.

    In the order of their numbers, a literal is kept while fewer repeats of its parent came
    before it than it takes to reach its number. A parent whose own first row is a repeat
    has one more of them.
    """

    def run(table: pa.Table) -> pa.Table:
        columns = (table.column(c).to_pylist() for c in ("_depth", "_name", "_k", "_seen", "_literal"))
        keys = [repr(k) for k in table.column("_key").to_pylist()]
        kept: dict[tuple[str, str], bool] = {}
        counts: dict[tuple[str, str], int] = {}
        out = []
        for _, parent, number, seen, literal, at in sorted(zip(*columns, range(len(keys)))):
            key = keys[at]
            before = max(seen - kept.get((key, parent), True), 0)
            done = counts.get((key, parent), 0)
            keeps = kept[key, literal] = before <= number - 1 - done
            out.append((at, literal, keeps, None))
            if keeps:
                counts[key, parent] = done + 1
                out.append((at, parent, None, number - done))
        rows, names, flags, skips = zip(*out)
        return pa.table({
            "_key": table.column("_key").combine_chunks().take(pa.array(rows)),
            "_name": pa.array(names, pa.string()),
            "_kept": pa.array(flags, pa.bool_()), "_skip": pa.array(skips, pa.int64()),
        })

    return run  # travels with its code: executors need no copy of this package


def _decided_literals(numbered: DataFrame, pos: str) -> DataFrame:
    """``(_key, _name, _kept, _skip)`` of names that meet another one, written.

    A literal with a parent name has a row that tells whether it keeps its name. For each
    kept one the parent has a row with the repeat number from which its number is passed.
    """
    names = numbered.groupBy("_key", "_name").agg(F.min(pos).alias("_first"))
    parsed = names.withColumn("_stem", stem(F.col("_name"))).select(
        "_key", F.col("_name").alias("_literal"), "_first",
        F.concat(F.regexp_extract("_stem", _NUMBERED, 1), suffix(F.col("_name"))).alias("_name"),
        F.regexp_extract("_stem", _NUMBERED, 2).try_cast("long").alias("_k"),
        F.concat(F.regexp_replace("_stem", _NUMBERS, ""), suffix(F.col("_name"))).alias("_root"),
        F.length("_stem").alias("_depth"),
    ).filter(F.col("_k").isNotNull())
    literals = cut(join_on(parsed, names.select("_key", "_name"), ["_key", "_name"], "left_semi"))

    # Rows of the parent seen before the literal, counted along ``pos``.
    parents = literals.select("_key", "_name").distinct()
    events = (
        lookup(numbered, parents, ["_key", "_name"], pos, "left_semi")
        .select("_key", "_name", F.col(pos).alias("_at"))
        .unionByName(literals.withColumnRenamed("_first", "_at"), allowMissingColumns=True)
    )
    counted = scan(
        events, ["_key", "_name"], "_at",
        total={"_seen": F.col("_literal").isNull().cast("long")},
    ).filter(F.col("_literal").isNotNull())
    schema = T.StructType([
        numbered.schema["_key"], T.StructField("_name", T.StringType()),
        T.StructField("_kept", T.BooleanType()), T.StructField("_skip", T.LongType()),
    ])
    # Small families share a group: one for each costs more than deciding it.
    groups = literals.count() // DECIDED_TOGETHER + 1
    together = F.pmod(F.xxhash64("_key", "_root"), F.lit(groups)).alias("_group")
    return cut(counted.groupBy(together).applyInArrow(_decide(), schema))
