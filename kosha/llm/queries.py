"""The pN_ queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kosha.session import table

from . import lookalikes, mapping, neardup, ocr, packing, pii, repetition, sentences, splitting, tokens


def _doc_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", as_counts=True)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").filter(F.get_json_object("metadata", "$.source_kind") == "typed")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(_typed(spark, d), "res_no", "raw_text")


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "resolutions"), "res_no", "raw_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mapping.found(table(spark, d, "resolutions"), table(spark, d, "programs"), table(spark, d, "faculties"))


def p2_mapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_resolutions(table(spark, d, "resolutions"), table(spark, d, "programs"), table(spark, d, "faculties"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(table(spark, d, "resolutions"), "res_no", ["title", "raw_text"])


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.forms(table(spark, d, "resolutions"), "res_no", ["title", "raw_text"])


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.classes(table(spark, d, "resolutions"), "res_no", ["title", "raw_text"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "resolutions"), "res_no", "raw_text")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "resolutions"), "res_no", "raw_text")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.links(table(spark, d, "resolutions"), "res_no", "raw_text")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return neardup.members(table(spark, d, "resolutions"), "res_no", "raw_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.found(table(spark, d, "resolutions"), table(spark, d, "page_results"))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ocr.paragraphs(table(spark, d, "resolutions"), table(spark, d, "page_results"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "resolutions"), "res_no", "raw_text")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.piece_rows(table(spark, d, "resolutions"), "res_no", "raw_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.found(table(spark, d, "resolutions"), "res_no", "raw_text")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    got = repetition.repetition(table(spark, d, "resolutions"), "res_no", "raw_text")
    return got.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """By the containers that the documents' pieces were put into."""
    return packing.found(p9_containers(spark, d), "doc_id")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_doc_sizes(spark, d), "doc_id", "n_tokens")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), "doc_id", "text").distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_sentences, p2_found, p2_mapped, p3_found, p3_forms, p3_classes, p4_found, p4_groups, p4_links, p4_members, p5_found, p5_paragraphs, p6_found, p6_pieces, p7_found, p7_shares, p8_ids, p9_found, p9_containers, p10_found, p10_masked)}


_P4 = """
WITH t AS (SELECT res_no, replace(replace(raw_text, ' ', ''), chr(10), '') AS s FROM resolutions WHERE raw_text IS NOT NULL),
g AS (SELECT DISTINCT res_no, md5(substring(s, i, 10)) AS g FROM (SELECT res_no, s, unnest(range(1, length(s) - 8)) AS i FROM t)),
n AS (SELECT res_no, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.res_no AS a, b.res_no AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.res_no < b.res_no GROUP BY 1, 2)
SELECT a AS res_no_a, b AS res_no_b FROM c JOIN n x ON x.res_no = a JOIN n y ON y.res_no = b WHERE c >= 0.6::DOUBLE * (x.n + y.n - c)"""

_P4_TEXTS = """t AS (SELECT res_no, coalesce(replace(replace(raw_text, ' ', ''), chr(10), ''), '') AS s FROM resolutions),
m AS (SELECT res_no, s, min(res_no) OVER (PARTITION BY s) AS rep FROM t),
g AS (SELECT DISTINCT rep, md5(substring(s, i, 10)) AS g FROM (SELECT rep, s, unnest(range(1, length(s) - 8)) AS i FROM m WHERE rep = res_no)),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b, round(c::DOUBLE / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c >= 0.6::DOUBLE * (x.n + y.n - c))"""
_P4_LINKS = f"WITH {_P4_TEXTS} SELECT a AS rep_a, b AS rep_b, similarity FROM l"
_P4_MEMBERS = f"WITH {_P4_TEXTS} SELECT res_no, rep FROM m"
_P4_GROUPS = f"""
WITH RECURSIVE {_P4_TEXTS}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w AS (SELECT rep, rep AS other FROM (SELECT DISTINCT rep FROM m) UNION SELECT w.rep, e.b FROM w JOIN e ON e.a = w.other),
k AS (SELECT rep, min(other) AS group_id FROM w GROUP BY 1), d AS (SELECT a AS rep, count(*) AS n FROM e GROUP BY 1)
SELECT res_no, group_id, coalesce(d.n, 0) AS n_links FROM m JOIN k USING (rep) LEFT JOIN d USING (rep)"""

_P6 = """
WITH l AS (SELECT res_no, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM resolutions),
b AS (SELECT *, trim(line, ' ') = '' AS blank FROM l), g AS (SELECT *, i - row_number() OVER (PARTITION BY res_no ORDER BY i) AS island FROM b WHERE NOT blank),
k AS (SELECT res_no, min(i) AS first, sum(length(line)) + count(*) - 1 AS n FROM g GROUP BY res_no, island),
o AS (SELECT res_no, n, row_number() OVER (PARTITION BY res_no ORDER BY first) - 1 AS block_no FROM k)
SELECT res_no, block_no FROM o WHERE n > 1500"""

_P7 = """
WITH t AS (SELECT res_no, replace(replace(raw_text, ' ', ''), chr(10), '') AS s FROM resolutions),
w AS (SELECT res_no, count(*) AS n, count(DISTINCT g) AS d FROM (SELECT res_no, substring(s, i, 20) AS g FROM (SELECT res_no, s, unnest(range(1, length(s) - 18)) AS i FROM t)) GROUP BY 1)
SELECT res_no FROM w WHERE 10 * (n - d) >= 3 * n"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the other operators are tested by brute force, round trips and held-out accuracy."""
    return {"p4_found": _P4, "p4_groups": _P4_GROUPS, "p4_links": _P4_LINKS, "p4_members": _P4_MEMBERS, "p6_found": _P6, "p7_found": _P7}
