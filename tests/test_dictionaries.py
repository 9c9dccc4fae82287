"""Dictionaries, routes and loaders on small cases, and against plain loops."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from kosha.operators import dense, loaders
from kosha.operators import dictionaries as dc

SF = "/root/testdata/sf0.001"
P = [("หลักสูตร", dc.Entry(c, c)) for c in ("หลักสูตรวิทยาศาสตรบัณฑิต สาขาวิชาเคมีสีเขียว", "หลักสูตรวิทยาศาสตรมหาบัณฑิต สาขาวิชาเคมีสีเขียว", "หลักสูตรแพทยศาสตรบัณฑิต", "หลักสูตรวิทยาศาสตรบัณฑิต สาขาวิชาสถิติ")]
F_ = [("คณะ", dc.Entry("คณะวิทยาการสมุทร", "คณะวิทยาการสมุทร")), ("คณะ", dc.Entry("คณะประมงและทะเล", "คณะวิทยาการสมุทร")), ("วิทยาลัย", dc.Entry("วิทยาลัยการบิน", "วิทยาลัยการบิน"))]


def test_programmes():
    p = dc.Programs(P)
    assert p.names("ขอปิด หลักสูตรวิทยาศาสตรมหาบัณฑิต สาขาวิชาเคมีสีเขียว ปี 2566") == [P[1][1].name]
    assert p.names("หลักสูตรวิทยาศาสตรบัณฑิต สาขาวิชาเคมีสีเขีอว") == [P[0][1].name]
    assert p.judged("หลักสูตร", "หลักสูตรทันตแพทยศาสตรบัณฑิต")[0] is None and p.judged("หลักสูตร", "หลักสูตรทันตแพทยศาสตรบัณฑิต")[3] == "head"
    assert p.names("หลักสูตรวิทยาศาสตรดุษฎีบัณฑิต สาขาวิชาเคมีสีเขียว") == []
    assert p.names("") == [] and dc.Programs([]).names("หลักสูตร") == []
    assert dc.level("หลักสูตรระยะสั้น") is None and dc.field("ไม่มี") is None and dc.head("x") is None


def test_faculties():
    f = dc.Faculties(F_)
    assert f.names("ของคณะประมงและทะเล และวิทยาลัยการบิน") == ["คณะวิทยาการสมุทร", "วิทยาลัยการบิน"]
    assert f.names("มหาวิทยาลัยการบิน") == [] and f.names("คณะกรรมการ") == []


def test_tags_equal_plain_loops(spark):
    names = [(r["prefix_type"], n, r["canonical"]) for r in spark.read.parquet(f"{SF}/faculties.parquet").orderBy("faculty_id").collect() for n in [r["canonical"], *(r["aliases"] or [])]]
    rows = {r["res_no"]: r for r in e.queries()["title_tags"](spark, SF).collect()}
    seen = 0
    for r in spark.read.parquet(f"{SF}/resolutions.parquet").collect():
        t, want = r["title"] or "", set()
        for at in range(len(t)):
            for prefix in {p for p, _, _ in names}:
                if t.startswith(prefix, at) and not t.endswith("มหา", 0, at):
                    hit = next((c for p, n, c in names if p == prefix and SequenceMatcher(None, n, t[at : at + len(n) + 4]).ratio() >= 0.82), None)
                    want |= {hit} - {None}
        assert rows[r["res_no"]]["faculties"] == sorted(want)
        seen += bool(want)
    assert seen > 3


def test_people(spark):
    text = "ผู้ช่วยศาสตราจารย์ ดร.วุฒิชัย ชาติพัฒนา และ ศ. นั้น ดร.นั้น จะได้ <td>รศ.อำภา</td><td>มิตะถาวร</td> อ.รัตมณี<br/>บุญกล้า"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string").select("k", dc.people(F.col("t")).alias("p"))
    got = {r["k"]: r["p"] and [tuple(x) for x in r["p"]] for r in df.collect()}
    assert got[1] == [("ผศ.ดร.", "วุฒิชัย", "ชาติพัฒนา"), ("รศ.", "อำภา", "มิตะถาวร"), ("อ.", "รัตมณี", "บุญกล้า")] and got[2] is None and got[3] == []
    assert [x[2] for x in dc.people_at(text)] == ["ผศ.ดร.วุฒิชัย ชาติพัฒนา", "รศ.อำภา มิตะถาวร", "อ.รัตมณี บุญกล้า"]
    q = spark.createDataFrame([("ผศ. ธนา ก",)], "t string").select(dc.close_titles(F.col("t")).alias("t")).first()["t"]
    assert q == "ผศ.ธนา ก"


def test_affiliations(spark):
    near = "ผศ.วุฒิชัย ชาติพัฒนา สังกัดคณะวิทยาการสมุทร"
    rows = [(1, near), (2, "ผศ.วุฒิชัย ชาติพัฒนา " + "x" * 130 + " สังกัด: คณะประมงและทะเล"), (3, "สังกัด กอง"), (4, None)]
    got = {tuple(r) for r in dc.affiliations(spark.createDataFrame(rows, "k int, t string"), "k", "t", dc.Faculties(F_)).collect()}
    assert got == {(1, "ผศ.วุฒิชัย ชาติพัฒนา", "คณะวิทยาการสมุทร"), (2, None, "คณะวิทยาการสมุทร")}


def test_mentions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "NAMES", 2)
    names = spark.createDataFrame([("big data",), ("data",), ("Sea",), (" ",), (None,), ("ทะเล",)], "n string")
    texts = spark.createDataFrame([(1, "BIG  DATA"), (2, "big database"), (3, "อ่าวทะเลไทย sea"), (4, None), (5, "")], "k int, t string")
    got = {tuple(r) for r in dc.mentions(texts, "k", "t", names, "n").collect()}
    assert got == {(1, "big data"), (1, "data"), (3, "Sea"), (3, "ทะเล")}
    assert {tuple(r) for r in dc.widest(dc.mentions(texts, "k", "t", names, "n"), "k", "n").collect()} == got - {(1, "data")}


def test_grids_and_course_tables(spark):
    grid = "a Curriculum Mapping x <table>1</table> -- <table>2</table>" + "z" * 600 + "<table>3</table>"
    assert loaders.without_mapping(grid) == "a " + "z" * 600 + "<table>3</table>"
    assert loaders.without_mapping("SKILL MAPPING" + "y" * 9000) == "y" * (9013 - 8000) and loaders.without_mapping(None) is None
    table = "<table><td>รหัส/หน่วยกิต</td><td>๒๐๖๒๖๒๑๔<br/>4 (2-4-6)</td><td>Deep <b>Sea</b> -</td><td>20626214</td><td>again</td><td>long text</td></table>"
    assert loaders.short_courses(f"x{table}y") == "x20626214 Deep Seay"
    assert loaders.short_courses("<table><td>เปลี่ยนเป็น 12345678</td></table>") == "<table><td>เปลี่ยนเป็น 12345678</td></table>"
    df = spark.createDataFrame([(1, "# Document: x\n" + grid + " ๑๒"), (2, None)], "k int, t string")
    assert {r["k"]: r["t"] for r in loaders.load(df, "k", "t", "normalized").collect()} == {1: "a " + "z" * 600 + "<table>3</table> 12", 2: None}
    with pytest.raises(ValueError):
        loaders.load(df, "k", "t", "none")


def test_pages(spark):
    text = "before\n## Page 1\n\nold\n## Page 2\ntwo\n## Page 2\nmore\n## Page 3\nthree\n## Page 1\nagain"
    assert loaders.with_page(text, 2, " new ") == "before\n## Page 1\n\nold\n## Page 2\n\nnew\n\n## Page 3\nthree\n## Page 1\nagain"
    assert loaders.with_page(text, 1, "x") is None and loaders.with_page(text, 9, "x") is None
    df = spark.createDataFrame([(1, text, [(3, "c"), (9, "x"), (2, None)]), (2, None, [(1, "x")]), (3, "t", None)], "k int, t string, p array<struct<page:int,body:string>>")
    got = {r["k"]: (r["t"], r["n_replaced"], r["n_missing"]) for r in loaders.replaced_pages(df, "k", "t", "p").collect()}
    assert got[1][1:] == (1, 1) and "\n\nc\n\n" in got[1][0] and got[2] == (None, 0, 0) and got[3] == ("t", 0, 0)
    parts = df.select("k", F.explode(loaders.page_parts(F.col("t"), 3)).alias("p")).select("k", "p.label", "p.body").collect()
    assert [(r["label"], r["body"]) for r in parts if r["k"] == 1][:4] == [("Page 1", "old"), ("Page 2", "two"), ("Page 2.1", "mor"), ("Page 2.2", "e")]
    assert [(r["label"], r["body"]) for r in parts if r["k"] == 3] == [("chunk1", "t")]


def test_bundles(spark):
    item = lambda n, name: f"{n}) หลักสูตร{name} สาขาวิชา{name}\n\nโดยผ่านการพิจารณาจากคณะกรรมการประจำส่วนงานวิชาการเรียบร้อยแล้ว {name}\n"
    good = "จำนวน ๒ หลักสูตร ดังนี้\n" + item("๑", "เคมี") + item("๒", "ชีววิทยา")
    assert loaders.bundle(good)[:2] == ("split", 2) and [good[i : i + 2] for i in loaders.bundle(good)[2]] == ["๑)", "๒)"]
    assert loaders.bundle("จำนวน ๒ หลักสูตร\n" + item("๑", "เคมี") + item("๒", "เคมี"))[::3] == ("mismatch", "one title")
    assert loaders.bundle("จำนวน ๒ หลักสูตร\n๑) หลักสูตรก\n๒) หลักสูตรข")[::3] == ("mismatch", "short")
    assert loaders.bundle("จำนวน 1 หลักสูตร")[0] == "single" and loaders.bundle("x")[0] == "none" and loaders.bundle(None)[0] == "none"
    df = spark.createDataFrame([(1, good), (2, None)], "k int, t string")
    assert {r["k"]: r["action"] for r in loaders.bundles(df, "k", "t").collect()} == {1: "split", 2: "none"}


def test_spans_and_metadata(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["B-P", "I-P", "O", "I-L", "B-L"], {"x": "1", "y": "2"}, {"y": "3"}), ([], [], None, None)], "w array<string>, t array<string>, p map<string,string>, o map<string,string>")
    rows = df.select(loaders.iob_spans(F.col("w"), F.col("t")).alias("s"), loaders.inherited(F.col("p"), F.col("o")).alias("m")).collect()
    assert [tuple(x) for x in rows[0]["s"]] == [("P", "ab"), ("L", "d"), ("L", "e")] and rows[0]["m"] == {"x": "1", "y": "3"} and rows[1]["s"] == [] and rows[1]["m"] == {}
    t = df.select(loaders.blank_tables(F.lit("a<table>x</table>b<TABLE></TABLE>")).alias("t")).first()["t"]
    assert t == "a" + " " * 16 + "b" + " " * 15


def test_models(spark):
    def model():
        import numpy as np

        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    got = dense.embed(spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string"), "k", "t", model)
    assert {r["k"]: r["v"] for r in got.collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    with pytest.raises(ValueError):
        dense.remote_model(None)
    words = spark.createDataFrame([(["a", ",", "b"],), ([",", "."],), ([],)], "w array<string>")
    assert [r[0] for r in words.select(dense.document_tokens(F.col("w"))).collect()] == [["a", "b"], [","], []]
    assert [len(r[0]) for r in words.select(dense.query_tokens(F.col("w"), 4)).collect()] == [4, 4, 4]


def test_nearest(spark):
    names = [(1, "คณะวิทยาการสมุทร"), (2, "คณะวิทยาการสมุทธ"), (3, "วิทยาลัยการบิน")]
    df = spark.createDataFrame([("คณะวิทยาการสมุทร",), ("คณะวิทยาการสมุท",), ("x",), ("",)], "t string")
    got = {r["t"]: (r["ref_id"], r["ratio"]) for r in dc.nearest(df, "t", names).collect()}
    assert got["คณะวิทยาการสมุทร"] == (1, 1.0) and got["คณะวิทยาการสมุท"][0] == 1 and len(got) == 2
