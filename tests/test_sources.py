import json

import pytest
from pyspark.sql import functions as F

from kosha.sources import tables
from kosha.streaming import ingest


def test_corpus(spark, tmp_path):
    d = tmp_path / "2566" / "ครั้งที่ 3s"
    d.mkdir(parents=True)
    (d / "เรื่อง+ก.md").write_text("﻿# Document: x\nbody", encoding="utf-8")
    (d / "b.md").write_text("x", encoding="utf-8")
    (d / "เรื่อง+ก_LINK.txt").write_text("https://x/1\n", encoding="utf-8")
    (tmp_path / "other.md").write_text("x", encoding="utf-8")
    (d / "manifest.json").write_text(json.dumps([{"file": "b.md", "title": "B", "url": "u"}]), encoding="utf-8")
    rows = {r["title"]: r for r in tables.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"เรื่อง+ก", "B"} and rows["เรื่อง+ก"]["raw_text"].startswith("# Document") and rows["B"]["source_url"] == "u" and rows["B"]["session"] == "3s" and rows["เรื่อง+ก"]["source_url"] == "https://x/1"


def test_index_and_results(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, 1, "k", "r", 1, 0.5, "x"), ("c", 1, 2, "k2", "r", None, None, "x")], tables.RESULTS)
    tables.save_index(df, str(tmp_path / "i"), 2)
    assert tables.load_index(spark, str(tmp_path / "i")).count() == 2
    (tmp_path / "i" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        tables.load_index(spark, str(tmp_path / "i"))
    tables.save_results(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).filter("combination_id = 'c'").count() == 2
    body = json.loads(tables.results_json(df).first()["body"])
    assert body["top_k"] == 2 and [x["rank"] for x in body["results"]] == [1, 2]
    a = tables.docset_hash(df.select(F.lit("g").alias("g"), "chunk_id"), "g", "chunk_id").first()
    b = tables.docset_hash(df.orderBy(F.desc("rank")).select(F.lit("g").alias("g"), "chunk_id"), "g", "chunk_id").first()
    assert a["docset"] == b["docset"] and a["n"] == 2


def test_stored_tables_are_cleaned(spark):
    from kosha.session import clean, stored

    df = stored(spark.range(5))
    assert df.count() == 5 and len(df.inputFiles()) > 0
    clean(spark)
    assert stored(spark.range(3)).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        df.collect()


def test_stream(spark, tmp_path):
    rows = [(1, "p", 1, ["f"], "a", "2025-01-01 00:00:00"), (1, "p", 1, ["f"], "a", "2025-01-01 00:00:00"), (2, "p", 2, ["f"], None, "2025-01-01 01:00:00")]
    src = tmp_path / "in"
    write = lambda r: spark.createDataFrame(r, "staging_no long, pdf string, page long, files array<string>, new_text string, at string").withColumn("staged_at", F.col("at").cast("timestamp_ntz")).drop("at").coalesce(1).write.mode("append").parquet(str(src))
    write(rows)
    go = lambda: ingest.append_once(ingest.new_readings(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    write([(2, "p", 2, ["f"], "late", "2025-01-01 01:00:00"), (3, "p", 3, ["f"], "c", "2025-01-01 02:00:00")])
    go()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("staging_no").collect()) == [1, 2, 3]


def test_gold_and_vectors(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"query": "a", "entity_type": "t", "relevant_resolution_ids": ["x", "y"]}, {"query": "b"}]), encoding="utf-8")
    assert [(r["query_id"], r["resolution_id"]) for r in tables.read_gold(spark, str(tmp_path / "g.json")).orderBy("query_id", "resolution_id").collect()] == [(0, "x"), (0, "y"), (1, None)]
    docs = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, [[1.0, 0.0], [0.0, 1.0]])], "k int, v array<array<double>>")
    tables.save_vector_documents(docs, str(tmp_path / "v"), "k", "v")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2
    for bad in ([(1, [])], [(1, [[1.0], [1.0, 2.0]])], [(1, None)]):
        with pytest.raises(ValueError):
            tables.save_vector_documents(spark.createDataFrame(bad, "k int, v array<array<double>>"), str(tmp_path / "w"), "k", "v")
