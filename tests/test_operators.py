import pytest
from pyspark.sql import functions as F

from kosha.operators import chunkers as ch
from kosha.operators import dense, entities, fusion, lexical, metrics, quality, stats
from kosha.plans.experiment import Experiment, Strategy
from kosha.plans.registry import Registry
from kosha.session import stored


def cells(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_chunkers(spark):
    t = F.col("t")
    assert cells(spark, ch.fixed_size(t, 4, 2), "abcdefg") == ["abcd", "cdef", "efg", "g"]
    assert cells(spark, ch.fixed_size(t, 4), "") == [] and cells(spark, ch.fixed_size(t, 4), None) == []
    with pytest.raises(ValueError):
        ch.fixed_size(t, 4, 4)
    assert [tuple(p) for p in cells(spark, ch.pages(t), "a\n## Page 3\n\n b \n##  Page 5\n  ")] == [(1, "a"), (3, "b")]
    assert cells(spark, ch.pack(ch.sentences(t), 8), "Ab. Cd. Efghijklmno. P.") == ["Ab. Cd. ", "Efghijklmno. ", "P."]
    assert cells(spark, ch.merge_short(F.split(t, "/"), 3), "a/bb/cccc/d") == ["abb", "ccccd"]
    assert cells(spark, ch.merge_short(F.split(t, "/"), 9), "a/b") == ["ab"]
    df = spark.createDataFrame([(1, "aa bb cc dd"), (2, None), (3, "")], "k int, t string")
    words = [r["chunk"] for r in ch.python_chunks(df, "k", "t", "words", 6, 3).orderBy("chunk_index").collect()]
    assert words == ["aa bb ", "bb cc ", "cc dd"]
    # back until the overlap is reached, not until it would be exceeded; a word longer than the size stands alone
    assert ch.words("aa bb cc dd", 6, 2) == ["aa bb ", "bb cc ", "cc dd"]
    assert ch.words("aa bb cc dd", 6, 4) == ["aa bb ", "cc dd"]
    assert ch.words(" a toolongword b", 5, 0) == ["a ", "toolongword ", "b"] and ch.words("  ", 5, 0) == []
    rec = [r["chunk"] for r in ch.python_chunks(df, "k", "t", "recursive", 5, 0).orderBy("chunk_index").collect()]
    assert rec == ["aa bb", "cc dd"]


def test_bm25_matches_its_definition(spark):
    import math

    docs = ["a b c", "a a d", "a e", "", "b e f"]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, t string")
    q = spark.createDataFrame([(0, "a b b zz")], "q int, t string")
    got = {r["k"]: r["score"] for r in lexical.bm25(q, "q", "t", lexical.weighted_postings(df, "k", "t"), "k", 10).collect()}
    words = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    df_of = {t: sum(t in w for w in words) for w in words for t in w}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df_of.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    for i, w in enumerate(words):
        want = sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in "a b b zz".split())
        assert got.get(i, 0) == pytest.approx(want, abs=1e-5)


def test_cosine(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = [(r["query_key"], r["id"], r["score"]) for r in dense.cosine_top_k(df.filter("id in (1, 2)"), df, "id", "v", 3).orderBy("query_key", "rank").collect()]
    assert got == [(1, 1, 1.0), (1, 5, 1.0), (1, 3, 0.707107), (2, 1, 0.0), (2, 2, 0.0), (2, 3, 0.0)]
    assert dense.cosine_top_k(df.filter("id > 9"), df, "id", "v", 3).count() == 0
    two = spark.createDataFrame([([[1.0, 0.0]], [[0.5, 0.0], [0.0, 2.0]])], "q array<array<double>>, d array<array<double>>")
    assert two.select(dense.maxsim(F.col("q"), F.col("d"))).first()[0] == 0.5


def test_fusion(spark):
    d = spark.createDataFrame([(0, "x", 2.0, 1), (0, "y", 1.0, 2)], "q int, k string, score double, rank int")
    lx = spark.createDataFrame([(0, "y", 5.0, 1), (0, "z", 4.0, 2)], "q int, k string, score double, rank int")
    order = lambda df: [r["k"] for r in fusion.ranked(df, "q", "k", 9).orderBy("rank").collect()]
    both = fusion.both(d, lx, "q", "k")
    assert order(fusion.rrf(both)) == ["y", "x", "z"]
    # the ends of the grid are the arms themselves
    assert order(fusion.rrf(both, 1.0))[:2] == ["x", "y"] and order(fusion.rrf(both, 0.0))[:2] == ["y", "z"]
    assert order(fusion.rrf(fusion.both(d, lx, "q", "k", 1)))[:2] == ["x", "y"]
    assert order(fusion.weighted(both, "q")) == ["y", "x", "z"]


def test_metrics(spark):
    r = spark.createDataFrame([("c", 1, i + 1, f"k{i}", doc, 1, 1.0, "r", None) for i, doc in enumerate(["r1", "r1", "r2", "r3", "r5"])] * 2, "combination_id string, query_id int, rank int, chunk_id string, resolution_id string, page long, score double, retriever string, run_at timestamp")
    q = spark.createDataFrame([(1, "r2"), (1, "r5"), (1, "r5"), (2, "r9")], "query_id int, resolution_id string")
    rows = {x["query_id"]: x for x in metrics.per_query(metrics.cleaned(r), q, (3, 5)).collect()}
    assert rows[1]["recall_3"] == 0.5 and rows[1]["recall_5"] == 1.0 and rows[1]["rr"] == pytest.approx(1 / 3, abs=1e-6)
    assert rows[1]["precision_5"] == 0.4 and rows[1]["ap_5"] == pytest.approx((1 / 3 + 2 / 5) / 2, abs=1e-6)
    assert rows[2]["rr"] == 0 and rows[2]["recall_5"] == 0


def test_islands(spark):
    text = "\n".join(["x" * 25] * 4 + ["short"] * 6 + ["", "x" * 25])
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = quality.line_repeats(df, "k", "t").collect()
    assert [(r["k"], r["n"], r["start"], r["end"]) for r in got] == [(1, 4, 0, 3)]
    cut = {r["k"]: r["t"] for r in quality.without_line_loops(df, "k", "t").collect()}
    assert cut[1].count("x" * 25) == 2 and cut[2] is None and cut[3] == ""
    run = " ".join(f"{i}." for i in range(1, 10))
    flood = spark.createDataFrame([(1, f"{run} <table> x {run} 4. 11. </table>"), (2, f"<table><td> ๓. {run} 10 11. </td></table>"), (3, None), (4, "<table></table>")], "k int, t string")
    assert {(r["k"], r["first"], r["n"], r["word_no"]) for r in quality.numeric_flood(flood, "k", "t").collect()} == {(1, 1, 9, 2), (2, 1, 9, 2)}
    row = lambda i, x: f"<tr><td>{i}.</td><td>ผศ.ดร.วุฒิชัย ชาติพัฒนา</td><td>{x}</td></tr>"
    loop = "<table>" + "".join(row(i, "same") for i in range(5)) + "</table>"
    roster = "<table>" + "".join(row(i, "abcde"[i]) for i in range(5)) + "</table>"
    names = spark.createDataFrame([(1, loop), (2, roster), (3, "<table>" + row(1, "a") * 3 + "</table>"), (4, None)], "k int, t string")
    assert [(r["k"], r["n"], r["n_rows_different"]) for r in quality.table_name_loops(names, "k", "t").collect()] == [(1, 5, 1)]
    marks = spark.createDataFrame([(1, "- = " * 9 + "a b a b a b a b a b a b c")], "k int, t string")
    assert [(r["start"], r["period"], r["n"]) for r in quality.cyclic_floods(marks, "k", "t").collect()] == [(18, 2, 6)]
    cyc = spark.createDataFrame([(1, "go " + "a b c " * 7 + "end")], "k int, t string")
    assert [(r["start"], r["period"], r["n"]) for r in quality.cyclic_floods(cyc, "k", "t").collect()] == [(1, 3, 7)]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60)], "a int, b int")
    got = {r["node"]: r["label"] for r in quality.components(e, "a", "b", stored).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[51] == 50 and got[60] == 60
    assert quality.components(e.filter("a > 99"), "a", "b", stored).count() == 0


def test_entities(spark):
    t = "รหัสนักศึกษา 65457387 AB 123456789 CD 12345678 EF ๘๗๖๕๔๓๒๑ GH 11112222 ab"
    assert cells(spark, entities.course_codes(F.col("t")), t) == ["12345678", "87654321"]
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 3), (3, "b", 5)], "id int, u string, at int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 9, "y"), ("a", 9, "z")], "u string, at int, v string")
    got = {r["id"]: r["near_v"] for r in entities.nearest_before(left, right, ["u"], "at", 5, "v").collect()}
    assert got == {1: "z", 2: None, 3: None}
    pairs = spark.createDataFrame([("p", "f"), ("p", "f"), ("p", "g"), ("q", None)], "k string, v string")
    assert {r["k"]: r["status"] for r in entities.votes(pairs, "k", "v").collect()} == {"p": "resolved", "q": "no_evidence"}
    assert cells(spark, entities.citations(F.col("t")), "[2] and [1] and [2]") == [2, 1]


def test_stats(spark):
    d = spark.createDataFrame([("g", i, x) for i, x in enumerate([0.1, 0.2, 0.3, 0.2])] + [("z", i, 0.0) for i in range(4)], "g string, i int, d double")
    rows = {r["g"]: r for r in stats.bootstrap(d, "g", "i", "d", 50).collect()}
    assert rows["g"]["p"] == 0.0 and rows["g"]["mean"] == 0.2 and rows["z"]["p"] == 1.0
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    assert {r["k"]: (r["adjusted"], r["reject"]) for r in stats.holm(p, ["f"], "k", "p").collect()} == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False)}


def test_experiment(spark):
    e = Experiment("x", {"chunker": [Strategy("a"), Strategy("b")], "embedder": [Strategy("c")]})

    def build(name, combo):
        if combo["chunker"].type == "b":
            raise RuntimeError("no")
        return spark.range(1)

    got = []
    assert len(e.run(build, lambda n, df: got.append(df.count()))) == 1 and got == [1] and len(e.errors) == 1
    with pytest.raises(ValueError):
        Experiment("x", {"a": [Strategy("a")], "b": []}, "paired").combinations()
    r = Registry()
    r.add("a", 1)
    with pytest.raises(ValueError):
        r.add("a", 2)


def test_loops_are_cut():
    loop = "begin <table><tr> " + "a b c " * 8 + "a b end"
    got, n = quality.without_loops(loop)
    assert got == "begin <table><tr> a b c end" and n == len(loop) - len(got)
    lines = "x\n" + "the same long line of text\n" * 5 + "y"
    assert quality.without_loops(lines) == ("x\nthe same long line of text\ny", len(lines) - len("x\nthe same long line of text\ny"))
    table = "<table> " + "p q " * 7 + "</table> " * 0 + "z"
    assert quality.without_loops(table)[0] == "<table> p q z"
    open_ = "<table> " + "p q</table> " * 7 + "z"
    assert quality.without_loops(open_)[0].count("</table>") >= 1 and quality.without_loops("")[0] == ""


def test_recursive_is_linear():
    import time

    began = time.time()
    out = ch.recursive("a" * 300_000, 512, 50)
    assert time.time() - began < 5 and all(len(x) <= 512 for x in out)
    assert ch.recursive("ab\n\ncd ef", 5, 0) == ["ab", "cd ef"] and ch.recursive("", 5, 0) == []
    words = " ".join(f"w{i}" for i in range(400))
    got = ch.recursive(words, 60, 20)
    assert all(len(x) <= 60 for x in got) and all(a.split()[-1] in b.split() for a, b in zip(got, got[1:]))
