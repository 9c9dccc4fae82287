from pyspark.sql import functions as F

from kosha.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_header(spark):
    assert one(spark, tx.strip_document_header(F.col("t")), t="# Document: a.pdf\n\n## Page 1\n# Document: b") == "## Page 1\n# Document: b"
    assert one(spark, tx.strip_document_header(F.col("t")), t=None) is None
    assert one(spark, tx.strip_document_header(F.col("t")), t="") == ""


def test_phrase(spark):
    p = tx.contains_phrase(F.col("h"), F.col("n"))
    assert one(spark, p, h="the Ocean  Studies unit", n="ocean studies") is True
    assert one(spark, p, h="Oceans", n="Ocean") is False
    assert one(spark, p, h="คณะOcean", n="ocean") is True
    assert one(spark, p, h="abc", n=" ") is False
    assert one(spark, p, h=None, n="a") is False
    assert one(spark, p, h="a.b", n="a.b") is True
    assert one(spark, p, h="axb", n="a.b") is False


def test_small_functions(spark):
    assert one(spark, tx.one_char_off(F.col("a"), F.col("b")), a="กขค", b="กขง") is True
    assert one(spark, tx.one_char_off(F.col("a"), F.col("b")), a="ab", b="abc") is False
    assert one(spark, tx.prefix_related(F.col("a"), F.col("b")), a="somch", b="somchai") is True
    assert one(spark, tx.prefix_related(F.col("a"), F.col("b")), a="som", b="somc") is False
    assert one(spark, tx.coverage(F.col("a"), F.col("b")), a="12. เรื่อง xx yy 7 การ", b="has x x") == 0.5
    assert one(spark, tx.coverage(F.col("a"), F.col("b")), a=" ", b="") == 1.0
    assert one(spark, tx.is_bad_output(F.col("a")), a="aaaaab") is True
    assert one(spark, tx.is_bad_output(F.col("a")), a=None) is True
    assert one(spark, tx.is_bad_output(F.col("a")), a="abcabc") is False
    assert one(spark, tx.novel_numbers(F.col("a"), F.col("b")), a="1 22 22 3", b="year 3") == 3
    assert one(spark, tx.highlight(F.col("a"), F.array(F.lit("b"), F.lit("abc"))), a="abc") == "[[a[[b]]c]]"
    assert one(spark, tx.verify_span(F.col("a"), F.col("b")), a="x  y", b="ax y") is True
    assert one(spark, tx.fuzzy_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == 0.75
    assert one(spark, tx.nfc(F.col("a")), a="é\xa0") == "\xe9 "
    assert one(spark, tx.meeting_key(F.col("a")), a="2566/3s/x").asDict() == {"year": 2566, "session": 3}
    assert one(spark, tx.meeting_key(F.col("a")), a="x").asDict() == {"year": 9999, "session": 9999}
    assert one(spark, tx.context_class(F.col("a"), F.lit(0)), a="<td>") == "table"
