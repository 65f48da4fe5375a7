"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    problems, *_ = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert not problems


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if n.startswith("lr_")))
def test_query_without_sql_gives_all_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() == (16 if name == "lr_metrics" else spark.read.parquet(f"{SF}/embeddings.parquet").count())


@needs_data
def test_entry(spark):
    assert sorted(entry.entry(spark).columns) == ["f1", "fn", "fp", "label", "precision", "recall", "tp"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
