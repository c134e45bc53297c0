import pytest
from pyspark.sql import functions as F

from gradeloom.operators import joins, outcomes


@pytest.mark.parametrize("limit", [0, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_lookup_joins_alike_when_broadcast_and_when_spread(spark, rows, monkeypatch, limit, how):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    left = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    left = left.unionByName(spark.createDataFrame([(None, 900), (7, 901)], "k long, n long"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "null")], "k long, v string")
    names = {0: "a", 1: "b", None: "null"}
    data = [(n % 3, n) for n in range(200)] + [(None, 900), (7, 901)]
    want = {
        "inner": [(k, n, names[k]) for k, n in data if k in names],
        "left": [(k, n, names.get(k)) for k, n in data],
        "left_semi": [(k, n) for k, n in data if k in names],
        "left_anti": [(k, n) for k, n in data if k not in names],
    }[how]
    assert rows(joins.lookup(left, right, ["k"], "n", how)) == sorted(want, key=repr)


def test_a_table_too_big_for_a_broadcast_gets_none_from_estimates(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    left = spark.range(20).select((F.col("id") % 4).alias("k"), "id")
    right = spark.range(4).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    found = joins.lookup(left, right, ["k"], "id")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20


def test_incident_texts_broadcast_no_jobs(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    jobs = spark.createDataFrame(
        [("j", "zip", "l.zip", "E", "/d")],
        "job_id string, request_type string, source_name string, error_message string, debug_path string",
    )
    files = spark.createDataFrame(
        [(1, "j", "a.pdf", "error", "boom")],
        "id long, job_id string, source_name string, status string, error_message string",
    )
    texts = outcomes.incident_texts(jobs, files)
    assert "BroadcastHashJoin" not in texts._jdf.queryExecution().executedPlan().toString()
    assert [r.job_id for r in texts.collect()] == ["j"]
