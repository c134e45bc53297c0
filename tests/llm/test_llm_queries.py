"""Registered queries: all there, SQL counterparts equal, the pipeline's stages."""

import hashlib

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from compare import _canonical, connect
from gradeloom.llm import ngram_join, pii

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_operator_has_one_query():
    names = contract.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(q for q in contract.oracle_sql() if q.startswith("op")))
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(contract.oracle_sql()[name])
    assert got == _canonical([c[0] for c in result.description], result.fetchall())


def test_the_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    counts, results = [docs.count()], [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], FOLDER).checkpoint())
        counts.append(results[-1].count())
    assert all(r.columns == columns for r in results[:-1])
    assert counts[1] == counts[0]  # every document has letters and a clear language
    roots = ngram_join.link_documents(results[1])
    assert {r.doc_id for r in results[2].collect()} == {r.component_id for r in roots.collect()}
    masked = pii.find_personal_data(results[3]).filter("n_email + n_ip + n_card + n_phone > 0")
    assert masked.count() == 0
    assert counts[5] == counts[4]
    texts = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in results[4].collect())
    assert texts == sorted(r.decoded_sha256 for r in results[5].collect())


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100
