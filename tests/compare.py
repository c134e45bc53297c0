"""Run registered queries and their SQL counterparts side by side.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _canonical(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, con, name: str, folder: str) -> tuple[str, str]:
    """``("match" | "rows-only" | "MISMATCH", detail)`` for one query."""
    from gradeloom.plans import registry

    df = registry.QUERIES[name](spark, folder)
    began = time.time()
    collected = df.collect()
    spent = time.time() - began
    got = _canonical(df.columns, [tuple(r) for r in collected])
    sql = registry.ORACLE.get(name)
    if sql is None:
        return "rows-only", f"{len(got[1])} rows"
    result = con.execute(sql)
    want = _canonical([c[0] for c in result.description], result.fetchall())
    types = {c[0]: str(c[1]) for c in result.description}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    drift = [f"{c}: {t} vs {types.get(c)}" for c, t in df.dtypes if kinds.get(t, t) != types.get(c)]
    note = f"spark {spent:.1f}s, {len(got[1])} rows" + (f"; types {drift}" if drift else "")
    if got == want:
        return "match", note
    if got[0] != want[0]:
        return "MISMATCH", f"columns {got[0]} vs {want[0]}"
    here, there = set(got[1]), set(want[1])
    extra = [r for r in got[1] if r not in there][:2]
    lost = [r for r in want[1] if r not in here][:2]
    return "MISMATCH", f"{len(got[1])} vs {len(want[1])} rows; only here {extra}; only there {lost}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from gradeloom.plans import registry

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    source = sys.argv[1]
    db = connect(source)
    for query in sys.argv[2:] or registry.QUERIES:
        began = time.time()
        try:
            verdict = compare(session, db, query, source)
        except Exception as error:  # report and go on with the next query
            verdict = ("ERROR", f"{type(error).__name__}: {str(error)[:700]}")
        print(f"{query:26s} {verdict[0]:10s} {time.time() - began:6.1f}s {verdict[1]}", flush=True)
