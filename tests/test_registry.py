"""Every registered query against its SQL counterpart."""

import pytest

from gradeloom.plans import registry

from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_sql(spark, db, name):
    verdict, note = compare(spark, db, name, FOLDER)
    assert verdict == "match", note
    assert "types" not in note, note


def test_flagship_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
