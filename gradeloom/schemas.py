"""Explicit schemas for every table the package reads or writes."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_TS, _B = T.TimestampType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: Cells as they come out of a page table: row 0 of each page holds the headers.
RAW_CELLS = _struct(file_id=_S, page_no=_I, row_no=_L, col_no=_I, cell=_S)

#: A page table as one JSON line: its rows of cells, the headers first.
PAGE_LINES = _struct(file_id=_S, page_no=_I, rows=T.ArrayType(T.ArrayType(_S)))

#: Arrivals of reports: a report that comes again has a higher ``arrival``.
MANIFEST = _struct(file_id=_S, arrival=_L, job_id=_S, source_name=_S)

#: Cells after the header row was promoted.
CELLS = _struct(file_id=_S, page_no=_I, row_no=_L, col_no=_I, header=_S, cell=_S)

#: Text of the first page of each report.
PAGE_TEXT = _struct(file_id=_S, text=_S)

#: One grade per student and code. ``pos`` is the extraction order.
POSITION = _struct(
    kind_no=_I, col_no=_I, first_row=_L, part=_struct(block=_L, piece=_I), nth=_I
)
RECORDS = _struct(
    file_id=_S, student=_S, code=_S, kind=_S, grade_num=_D, grade_text=_S, pos=POSITION
)

#: Cells of a detailed sheet, written and read back after staff edited it.
SHEET = _struct(
    row_no=_L, student=_S, col_pos=_I, mp=_S, slot=_I, header=_S, grade_num=_D, grade_text=_S,
    value=_S, file_id=_S,
)

#: Members of an uploaded archive.
MEMBERS = _struct(archive_id=_S, member_pos=_L, path=_S, is_dir=_B)

#: Module catalogue: one entry per programme and module.
CATALOG = _struct(programme=_S, programme_pos=_I, item_pos=_I, mp_code=_S, mp_name=_S)
CATALOG_JSON = T.MapType(_S, T.ArrayType(_struct(codi=_S, nom=_S)))

JOBS = _struct(
    id=_L, job_id=_S, request_type=_S, source_name=_S, source_size_bytes=_L,
    source_file_count=_I, remote_addr=_S, status=_S, returned_name=_S,
    returned_file_count=_I, error_message=_S, debug_path=_S, metadata_json=_S,
    stage=_S, progress_message=_S, progress_current=_I, progress_total=_I,
    created_at=_TS, started_at=_TS, completed_at=_TS, returned_at=_TS, updated_at=_TS,
)

FILES = _struct(
    id=_L, job_id=_S, source_name=_S, output_name=_S, status=_S, error_message=_S,
    created_at=_TS,
)

#: Lifecycle events; each event fills the columns it sets and leaves the rest null.
JOB_EVENTS = _struct(
    job_id=_S, seq=_L, event=_S, ts=_TS, status=_S, request_type=_S, source_name=_S,
    source_size_bytes=_L, source_file_count=_I, remote_addr=_S, stage=_S,
    progress_message=_S, progress_current=_I, progress_total=_I, metadata_json=_S,
    returned_name=_S, returned_file_count=_I, error_message=_S, debug_path=_S,
)

ARTIFACTS = _struct(job_id=_S, path=_S, size_bytes=_L)

TIMING_EVENT = _struct(
    event=_S, label=_S, total_seconds=_D,
    stages=T.ArrayType(_struct(name=_S, seconds=_D)),
    context=T.MapType(_S, _S),
)
