"""All registered queries and their SQL counterparts."""

from . import queries_jobs, queries_reports

_PARTS = [queries_reports, queries_jobs]

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
