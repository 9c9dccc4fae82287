"""Nulls, empty tables, ties and clashing names in the core's operators."""

import pytest
from pyspark.sql import functions as F

from kosha.operators import chunkers as ch
from kosha.operators import entities, fusion, lexical, metrics, quality, stats


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "   ", "b"), (4, "x y x", "b"), (4, "x y x", "b")], "k int, t string, term string")


def test_lexical(spark, dirty):
    assert [r["ts"] for r in dirty.select(lexical.tokens(F.col("t")).alias("ts")).collect()] == [[], [], [], ["x", "y", "x"], ["x", "y", "x"]]
    w = lexical.weighted_postings(dirty.select("k", "t"), "k", "t")
    q = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "q int, t string")
    got = lexical.bm25(q, "q", "t", w, "k", 5).collect()
    assert [(r["q"], r["k"], r["rank"]) for r in got] == [(1, 4, 1)]
    none = dirty.limit(0).select("k", "t")
    assert lexical.bm25(q, "q", "t", lexical.weighted_postings(none, "k", "t"), "k", 5).count() == 0


def test_chunkers(dirty):
    assert {r["k"] for r in ch.chunk_rows(dirty, "k", "t", lambda c: ch.fixed_size(c, 3)).collect()} == {4}
    assert ch.chunk_rows(dirty.limit(0), "k", "t", lambda c: ch.fixed_size(c, 3)).count() == 0


def test_quality(dirty):
    assert [(r["n"], r["kind"]) for r in quality.duplicates(dirty, "k", "t", "term").collect()] == [(2, "within")]
    assert quality.line_repeats(dirty.limit(0), "k", "t").count() == 0
    assert quality.token_runs(dirty, "k", "t").count() == 0


def test_rankings(spark):
    schema = "combination_id string, query_id int, rank int, chunk_id string, resolution_id string, page long, score double, retriever string, run_at timestamp"
    r = spark.createDataFrame([("c", 1, 1, None, None, None, None, None, None), ("c", 1, 2, "k", "r", 1, None, None, None), ("c", 1, 2, "k", "r", 1, None, None, None)], schema)
    q = spark.createDataFrame([(1, "r"), (1, None), (None, "r")], "query_id int, resolution_id string")
    got = {x["query_id"]: x["rr"] for x in metrics.per_query(metrics.cleaned(r), q, (5,)).collect()}
    assert got[1] == 0.5
    assert metrics.per_query(metrics.cleaned(r.limit(0)), q, (5,)).count() == 0
    assert metrics.per_query(metrics.cleaned(r), q.limit(0), (5,)).count() == 0


def test_fusion_of_nothing(spark):
    arm = spark.createDataFrame([], "q int, k string, score double, rank int")
    one = spark.createDataFrame([(1, "a", -1.0, 1)], "q int, k string, score double, rank int")
    assert fusion.ranked(fusion.rrf(fusion.both(arm, arm, "q", "k")), "q", "k", 5).count() == 0
    got = fusion.ranked(fusion.weighted(fusion.both(one, arm, "q", "k"), "q"), "q", "k", 5).first()
    assert got["score"] == 0.0


def test_stats_and_entities(spark, dirty):
    d = spark.createDataFrame([], "g string, i int, d double")
    assert stats.bootstrap(d, "g", "i", "d", 10).count() == 0
    assert entities.votes(dirty.select(F.col("k").cast("string").alias("k"), "term"), "k", "term").count() == 4
    last = entities.last_write(dirty, ["k"], ["t"]).collect()
    assert len(last) == 4
    assert {r["k"] for r in dirty.filter(entities.entity_filter({})).collect()} == {1, 2, 3, 4}
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert dirty.select(low.alias("l"), high.alias("h")).first()["l"] is None
