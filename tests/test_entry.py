import pytest

import __spark_entry__ as e


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["bm25_topk", "evaluate_multi_k"])
def test_runs(spark, name):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 5
    assert e.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
