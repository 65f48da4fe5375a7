"""Every registered query of this folder gives its whole table on the smallest tables."""

import os

import pytest

from labelmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
WHOLE = {"op1_mixing": ("documents", "doc_id"), "op3_simhash": ("documents", "doc_id"), "op5_suffix": ("documents", "doc_id"), "op6_quality": ("documents", "doc_id"),
         "op7_lattice": ("embeddings", "vec_id"), "op9_packing": ("documents", "doc_id"), "op10_fingerprints": ("documents", "doc_id"), "op13_bpe": ("documents", "doc_id")}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_gives_every_row(spark, name):
    source, key = WHOLE[name]
    got = queries.QUERIES[name](spark, SF)
    assert not {c for c in got.columns if c.startswith("__")}
    ids = [r[key] for r in got.collect()]
    want = [r[key] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect()]
    assert sorted(ids if name != "op9_packing" else set(ids)) == sorted(want)
