"""Audits on small cases."""

import pytest
from pyspark.sql import functions as F

from kosha.operators import audits, entities, stats
from kosha.sources import tables


def test_attribution(spark):
    hits = spark.createDataFrame([("r1", "a", None), ("r1", "b", None), ("r2", "a", None), ("r3", "z", None), ("r4", "a", "i2"), ("r5", None, None)], "r string, d string, rec string")
    indexes = spark.createDataFrame([("i1", "a"), ("i1", "b"), ("i2", "a"), ("i2", "a"), ("i2", None)], "i string, d string")
    got = {r["r"]: (r["i"], r["how"]) for r in audits.attributed(hits, indexes, "r", "d", "i", "rec").collect()}
    assert got == {"r1": ("i1", "elimination"), "r2": (None, "ambiguous"), "r3": (None, "none"), "r4": ("i2", "recorded"), "r5": (None, "ambiguous")}
    assert audits.attributed(hits, indexes.filter("i = 'i1'"), "r", "d", "i").filter("how = 'unique'").count() == 5


def test_vector_documents(spark):
    docs = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[1.0], [0.0, 1.0]]), (3, []), (4, [[float("nan"), 0.0]]), (5, [[2.0, 0.0]])], "k int, v array<array<double>>")
    got = {r["check"]: r["bad"] for r in audits.vector_documents(docs, "k", "v", spark.createDataFrame([(1,), (6,)], "k int")).collect()}
    assert got["not empty"] == 1 and got["one size"] == 1 and got["finite"] == 1 and got["aligned"] == 5
    assert {r["check"]: r["bad"] for r in audits.vector_documents(docs, "k", "v").collect()}["aligned"] is None


def test_citations(spark):
    a = spark.createDataFrame([("x", 1, "[1] [3] [1] [9]", True), ("y", 1, "ไม่พบข้อมูล", False), ("z", 2, "[1]", False)], "k string, query_id int, answer string, has_gold boolean")
    labels = spark.createDataFrame([("x", 1, "a"), ("x", 3, "b"), ("z", 1, "c")], "k string, label int, resolution_id string")
    q = spark.createDataFrame([(1, "a"), (1, "c")], "query_id int, resolution_id string")
    got = {r["k"]: r for r in audits.cited(a, labels, q, ["k"]).collect()}
    assert (got["x"]["n_cited"], got["x"]["n_phantom"], got["x"]["precision"], got["x"]["recall"]) == (3, 1, 0.5, 0.5)
    assert got["y"]["precision"] is None and got["y"]["recall"] == 0.0 and got["y"]["abstained"] and got["z"]["recall"] is None and got["z"]["precision"] == 0.0


def test_relabelling(spark):
    c = spark.createDataFrame([("a:0", "a", 0, "t"), ("b:0", "b", 0, "t")], "chunk_id string, resolution_id string, chunk_index long, text string")
    m = lambda *rows: spark.createDataFrame(rows, "old string, new string")
    assert {tuple(r) for r in audits.relabelled(c, m(("a", "x"))).collect()} == {("x:0", "x", 0, "t"), ("b:0", "b", 0, "t")}
    for bad in (m(("a", "b")), m(("a", "x"), ("b", "x"))):
        with pytest.raises(ValueError):
            audits.relabelled(c, bad)
    with pytest.raises(ValueError, match="chunk"):
        audits.relabelled(c.withColumn("chunk_index", F.lit(7)), m(("a", "x")))


def test_reports(spark):
    lines = spark.createDataFrame([("| b vs a | +0.5 | 0.01 | **yes** |",), ("| a vs c | -0.1 | 0.5 | no |",), ("|---|---|---|---|",), ("text",), (None,), ("| comparison | diff | p | significant |",)], "l string")
    got = {r["label"]: (r["diff"], r["p"], r["significant"]) for r in audits.report_rows(lines, "l").collect()}
    assert got == {"a vs b": (-0.5, 0.01, True), "a vs c": (-0.1, 0.5, False)}
    old = spark.createDataFrame([("p", 0.1, True), ("q", 0.1, False), ("r", 0.1, False), ("s", 0.1, False)], "k string, diff double, significant boolean")
    new = spark.createDataFrame([("p", 0.1, False), ("q", 0.2, False), ("r", 0.11, False), ("t", 0.1, False)], "k string, diff double, significant boolean")
    assert {r["k"]: r["change"] for r in audits.verdict_flips(old, new, "k").collect()} == {"p": "flipped", "q": "moved", "s": "only old", "t": "only new"}


def test_decisions(spark):
    cells = spark.createDataFrame([([(0.1, False), (-0.01, False)],), ([(-0.01, True)],), ([(-0.2, False)],), ([(float("nan"), False), (-0.2, True)],), ([],)], "c array<struct<diff:double,significant:boolean>>")
    assert [r[0] for r in cells.select(audits.decision(F.col("c"), 0.05)).collect()] == ["CONTINUE", "NARROW", "STOP", "INVALID", "INVALID"]
    rows = spark.createDataFrame([(["new", "new"], None), (["new", "old"], "apply-new"), (["new"], "keep-old"), (["old"], "x"), (["old"], None)], "v array<string>, d string")
    got = [r[0] for r in rows.select(audits.decided(rows, [], F.col("v"), F.col("d"))).collect()]
    assert got == ["apply: both new", "apply: by hand", "skip: keep old", "skip: deferred", "skip: waiting"]
    t = spark.createDataFrame([("ขออาจารย์ พิเศษ ร้อยละ 50",), ("อาจารย์พิเศษ",), (None,)], "t string")
    assert [r[0] for r in t.select(entities.adjunct_title(F.col("t"))).collect()] == [True, False, None]


def test_links(spark):
    f = spark.createDataFrame([(1, "abc", "u"), (2, "abx", "u"), (3, "solo", None), (4, "twin", None), (5, "twin", "v")], "k int, n string, l string")
    s = spark.createDataFrame([(10, "abc", "u"), (11, "a", "u"), (12, "solo", None), (13, "twin", None)], "k int, n string, l string")
    got = {tuple(r) for r in audits.linked(f, s, "k", "n", "l").collect()}
    assert got == {(1, 10, "link"), (3, 12, "name")}


def test_numbers_and_power(spark):
    df = spark.createDataFrame([(chr(97 + i),) for i in range(26)], "t string").repartition(5)
    assert [r["n"] for r in tables.numbered(df, "t", "n").orderBy("t").collect()] == list(range(26))
    d = spark.createDataFrame([("g", i, 0.001 * (i % 7)) for i in range(60)] + [("h", 1, None)], "g string, i int, d double")
    got = {r["effect"]: r["power"] for r in stats.power(d, "g", "i", "d", [0.0, 0.05], 40, 200).collect()}
    assert got[0.05] == 1.0 and got[0.0] < 0.3
    m = stats.draws(__import__("numpy").arange(2000), 50)
    assert abs(m.mean() - 24.5) < 0.5 and m.min() == 0 and m.max() == 49 and len({tuple(r) for r in m}) == 2000
