import json

import pytest
from pyspark.sql import functions as F

from kosha import __main__ as cli
from kosha.sources import indexes

DOCS = "resolution_id string, raw_text string, year string, session string, title string, source_url string, metadata string, source_path string"
ROWS = [("a", "## Page 2\nsea and sand", "2566", "1", "t", None, '{"lang": "en", "page": "9"}', "p1"), ("b", "forest and river", None, None, None, None, None, "p2"), ("c", None, None, None, None, None, None, "p3"), ("d", "", None, None, None, None, None, "p4"), ("e", "stone hill", None, None, None, None, None, "p5"), ("f", "wide field", None, None, None, None, None, "p6")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_built_once_and_found(spark, docs, tmp_path):
    root = f"file://{tmp_path}/i"
    one = indexes.build(docs, root, {"type": "fixed_size", "size": 20}, {"type": "hashing", "dim": 16})
    again = indexes.build(docs.orderBy(F.desc("resolution_id")), root, {"type": "fixed_size", "size": 20}, {"type": "hashing", "dim": 16})
    assert again.path == one.path and again.manifest["stamp"] == one.manifest["stamp"] and one.manifest["n_docs"] == 6 and one.manifest["n_chunks"] == 4
    meta = {r["resolution_id"]: r["metadata"] for r in one.chunks.collect()}
    assert meta["a"] == {"lang": "en", "page": "2", "year": "2566", "session": "1"} and meta["b"]["page"] == "1"
    other = indexes.build(docs, root, {"type": "sentence"}, {"type": "hashing", "dim": 8})
    known = indexes.catalogue(spark, root)
    assert len(known) == 2 and indexes.resolve(known, "sentence", "hashing") == other.path
    with pytest.raises(LookupError):
        indexes.resolve(known, "recursive", "hashing")
    q = spark.createDataFrame([(1, "sea"), (2, "river"), (3, "")], "query_id int, query string")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in indexes.retrieve(one, q, "bm25", 2).collect()}
    assert got == {(1, 1): "a:0", (1, 2): "b:0", (2, 1): "b:0", (2, 2): "a:0", (3, 1): "a:0", (3, 2): "b:0"}
    for how in ("dense", "hybrid", "served"):
        assert {r["chunk_id"] for r in indexes.retrieve(one, q, how, 1).filter("query_id = 2").collect()} == {"b:0"}
    tags = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", None)], "resolution_id string, faculties array<string>")
    assert [r["chunk_id"] for r in indexes.retrieve(one, q.filter("query_id = 1"), "bm25", 5, {"faculties": ["y"]}, tags).collect()] == ["b:0"]
    assert {(r["query_id"], r["chunk_id"]) for r in indexes.retrieve(one, q, "entity_lookup", 1, {"faculties": ["x"]}, tags).collect()} == {(i, "a:0") for i in (1, 2, 3)}
    assert indexes.retrieve(one, q, "entity_lookup").count() == 0
    both = indexes.compare({"one": one, "two": other}, q, "bm25", 1).collect()
    assert {r["index_name"] for r in both} == {"one", "two"}
    routed = indexes.routed(spark, root, q.withColumn("route", F.when(F.col("query_id") == 1, "person").otherwise("unmatched")), {"person": {"chunker": "sentence", "embedder": "hashing"}}, k=1).collect()
    assert {(r["route"], r["query_id"], r["resolution_id"]) for r in routed} >= {("person", 1, "a"), ("unmatched", 2, "b")}
    assert indexes.warm(spark, [one.path, f"{root}/none"]).keys() == {f"{root}/none"}


def test_refusals(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="several files"):
        indexes.require_unique(docs.union(spark.createDataFrame([("a", "x", None, None, None, None, None, "p9")], DOCS)))
    with pytest.raises(FileNotFoundError):
        indexes.load(spark, f"file://{tmp_path}")
    with pytest.raises(KeyError):
        indexes.build(docs, str(tmp_path), {"type": "none"}, {"type": "hashing"})
    with pytest.raises(ValueError, match="load the documents"):
        indexes.guard("bm25", ["resolution_id"], {"people": ["x"]})
    with pytest.raises(ValueError, match="filtered"):
        indexes.guard("served", ["people"], {"people": ["x"]})
    assert indexes.catalogue(spark, f"file://{tmp_path}/nothing") == []


def test_command_line(spark, docs, tmp_path, capsys):
    docs.write.parquet(str(tmp_path / "docs"))
    config = {"docs": str(tmp_path / "docs"), "root": f"file://{tmp_path}/i", "chunkers": [{"type": "fixed_size", "size": 20}, {"type": "none"}], "embedders": [{"type": "hashing", "dim": 8}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert cli.main(["build", str(tmp_path / "c.json")]) == 1 and "none" in capsys.readouterr().out
    config["chunkers"] = config["chunkers"][:1]
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert cli.main(["build", str(tmp_path / "c.json")]) == 0
    assert json.loads(capsys.readouterr().out)["n_chunks"] == 4
    assert cli.main(["retrieve", str(tmp_path / "c.json"), "--query", "river", "-k", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["chunk_id"] == "b:0"
