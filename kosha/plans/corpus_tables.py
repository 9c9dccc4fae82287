"""Tables inside texts, people, dictionary building and relabelling, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.functions import text as tx
from kosha.operators import dictionaries, quality
from kosha.plans.registry import query
from kosha.plans.retrieval_queries import chunks
from kosha.session import table
from kosha.sources import tables

_ROWS = r"<tr><td>([0-9]{8})</td><td>([^<]*)</td><td>([0-9]+\([0-9-]+\))</td></tr>"


@query(f"""
WITH x AS (SELECT res_no, regexp_extract_all(raw_text, '{_ROWS}', 1) AS c, regexp_extract_all(raw_text, '{_ROWS}', 2) AS t, regexp_extract_all(raw_text, '{_ROWS}', 3) AS u FROM resolutions),
y AS (SELECT res_no, unnest(c) AS code, unnest(t) AS title, unnest(u) AS credits, generate_subscripts(c, 1) AS pos FROM x)
SELECT res_no, code, title, credits FROM (SELECT *, row_number() OVER (PARTITION BY res_no, code ORDER BY pos) AS r FROM y) WHERE r = 1""")
def course_tables(spark: SparkSession, d: str) -> DataFrame:
    """The courses of the tables in each text: code, title and credits at the code's first occurrence."""
    part = lambda i: F.regexp_extract_all("raw_text", F.lit(_ROWS), F.lit(i))
    x = table(spark, d, "resolutions").select("res_no", F.posexplode(F.arrays_zip(part(1).alias("code"), part(2).alias("title"), part(3).alias("credits"))).alias("pos", "z"))
    first = x.select("res_no", "pos", "z.*").withColumn("r", F.row_number().over(Window.partitionBy("res_no", "code").orderBy("pos")))
    return first.filter("r = 1").select("res_no", "code", "title", "credits")


@query(r"SELECT res_no, regexp_replace(raw_text, '<table[^\n]*</table>\n?', '', 'g') AS body, length(raw_text) - length(regexp_replace(raw_text, '<table[^\n]*</table>\n?', '', 'g')) AS cut FROM resolutions")
def without_tables(spark: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace("raw_text", "<table[^\n]*</table>\n?", "")
    return table(spark, d, "resolutions").select("res_no", body.alias("body"), (F.length("raw_text") - F.length(body)).cast("bigint").alias("cut"))


_FLAT = r"trim(regexp_replace({0}, '[ \t\n\r]+', ' ', 'g'), ' ')"


@query(rf"""
WITH t AS (SELECT res_no, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS table_no FROM (SELECT res_no, regexp_extract_all(raw_text, '(?is)<table.*?</table>') AS l FROM resolutions)),
r AS (SELECT res_no, table_no, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT res_no, table_no, regexp_extract_all(t, '(?is)<tr>.*?</tr>') AS l FROM t)),
n AS (SELECT res_no, table_no, i, w, unnest(list_distinct(list_transform(regexp_extract_all(w, '<td>([^<]{{12,}})</td>', 1), lambda x: {_FLAT.format('x')}))) AS name FROM r)
SELECT res_no, table_no, name, count(*) AS n, count(DISTINCT {_FLAT.format("regexp_replace(translate(w, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[0-9]', '0', 'g')")}) AS n_rows_different FROM n GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def table_name_loops(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 12 characters or more in several rows of one table, however different the rows are (the operator's own thresholds, of four rows and half of them different, find none here)."""
    got = quality.table_name_loops(table(spark, d, "resolutions"), "res_no", "raw_text", "(?<=<td>)[^<]{12,}(?=</td>)", 2, 1.0)
    return got.withColumn("table_no", F.col("table_no").cast("bigint"))


_RANK = "CASE trim(replace({0}, 'ดร.', '')) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dictionaries.RANKS) + " ELSE trim(replace({0}, 'ดร.', '')) END || CASE WHEN contains({0}, 'ดร.') THEN 'ดร.' ELSE '' END"
_FOUND = " UNION ALL ".join(f"SELECT {{0}} AS id, unnest(regexp_extract_all({{1}}, '{p}', 1)) AS t, unnest(regexp_extract_all({{1}}, '{p}', 2)) AS given, unnest(regexp_extract_all({{1}}, '{p}', 3)) AS surname FROM {{2}}" for p in (dictionaries.TITLED.replace("{", "{{").replace("}", "}}"), dictionaries.IN_CELLS.replace("{", "{{").replace("}", "}}")))
_PEOPLE = lambda key, text, src: f"SELECT id, {_RANK.format('t')} AS title, given, surname FROM ({_FOUND.format(key, text, src)}) WHERE NOT list_contains({list(dictionaries.NO_NAMES)!r}, given)"


@query(f"WITH p AS ({_PEOPLE('doc_id', 'text', 'documents')}) SELECT doc_id, coalesce(people, []) AS people FROM documents LEFT JOIN (SELECT id AS doc_id, list_sort(list_distinct(list(title || given || ' ' || surname))) AS people FROM p GROUP BY 1) USING (doc_id) WHERE text IS NOT NULL")
def people_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The people with an academic title, ranks in their short form, distinct and sorted."""
    names = F.transform(dictionaries.people(F.col("text")), lambda p: F.concat(p["title"], p["given"], F.lit(" "), p["surname"]))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.array_sort(F.array_distinct(names)).alias("people"))


@query(f"""WITH p AS (SELECT DISTINCT id, title, given || ' ' || surname AS name FROM ({_PEOPLE('doc_id', 'text', 'documents')})), n AS (SELECT name, title, count(*) AS n FROM p GROUP BY ALL)
SELECT name, sum(n)::BIGINT AS total, count(*) AS n_titles, arg_max(title, (n, title)) AS top_title FROM n GROUP BY 1""")
def people_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """People by name, the title left out of the key: documents, titles, and the title most used (the last of those on ties)."""
    p = table(spark, d, "documents").select("doc_id", F.explode(dictionaries.people(F.col("text"))).alias("p"))
    n = p.groupBy(F.concat_ws(" ", "p.given", "p.surname").alias("name"), F.col("p.title").alias("title")).agg(F.count("*").alias("n"))
    return n.groupBy("name").agg(F.sum("n").alias("total"), F.count("*").alias("n_titles"), F.max_by("title", F.struct("n", "title")).alias("top_title"))


@query()
def fuzzy_faculties(spark: SparkSession, d: str) -> DataFrame:
    """The faculty whose name is most like each distinct tag, from a ratio of 0.82."""
    names = [(r[0], r[1]) for r in table(spark, d, "faculties").select("faculty_id", "canonical").collect()]
    tags = table(spark, d, "resolutions").select(F.explode("faculties").alias("tag")).filter("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))
    return tags.join(dictionaries.nearest(tags.select("tag"), "tag", names).withColumnRenamed("ref_id", "faculty_id"), "tag")


@query("WITH c AS (SELECT chunk_id, resolution_id, first(text) AS text, min(page) AS page FROM chunks GROUP BY ALL) SELECT split_part(resolution_id, '/', 1) AS year, count(*) AS n_chunks, count(DISTINCT resolution_id) AS n_docs, count_if(page IS NULL) AS without_page, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text)::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(length(text)::DOUBLE, 0.99), 6) AS p99 FROM c GROUP BY 1")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).withColumn("l", F.length("text"))
    return c.groupBy(F.split("resolution_id", "/")[0].alias("year")).agg(F.count("*").alias("n_chunks"), F.count_distinct("resolution_id").alias("n_docs"), F.count_if(F.col("page").isNull()).alias("without_page"), F.round(F.avg("l"), 6).alias("mean"), F.round(F.percentile("l", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("l", F.lit(0.99)), 6).alias("p99"))


@query("SELECT res_no, list_transform(faculties, lambda x: CASE WHEN x = 'คณะประมงและทะเล' THEN 'คณะวิทยาการสมุทร' ELSE x END) AS faculties FROM resolutions WHERE faculties IS NOT NULL")
def relabelled_tags(spark: SparkSession, d: str) -> DataFrame:
    """One element of an array replaced by another, in place."""
    new = F.transform("faculties", lambda x: F.when(x == "คณะประมงและทะเล", "คณะวิทยาการสมุทร").otherwise(x))
    return table(spark, d, "resolutions").filter("faculties is not null").select("res_no", new.alias("faculties"))


@query("SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, count(text) AS n_text, round(avg(n_chars), 4) AS mean FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def document_margins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count("text").alias("n_text"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("WITH p AS (SELECT DISTINCT staging_no, pdf, page, new_text FROM page_results), n AS (SELECT pdf, page, count(*) AS readings, count(DISTINCT new_text) AS texts, max(length(new_text)) AS longest, min(length(new_text)) AS shortest FROM p GROUP BY 1, 2) SELECT readings, texts, count(*) AS n, round(avg((longest - shortest)::DOUBLE / nullif(longest, 0)), 6) AS delta FROM n GROUP BY 1, 2")
def reading_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Pages by their number of readings and of different texts, with the mean relative difference in length."""
    p = table(spark, d, "page_results").select("staging_no", "pdf", "page", "new_text").distinct()
    n = p.groupBy("pdf", "page").agg(F.count("*").alias("readings"), F.count_distinct("new_text").alias("texts"), F.max(F.length("new_text")).alias("longest"), F.min(F.length("new_text")).alias("shortest"))
    return n.groupBy("readings", "texts").agg(F.count("*").alias("n"), F.round(F.avg(F.try_divide((F.col("longest") - F.col("shortest")).cast("double"), F.col("longest").cast("double"))), 6).alias("delta"))


@query("SELECT r.res_no, p.pdf, p.page, p.staging_no FROM (SELECT DISTINCT staging_no, pdf, page, unnest(files) AS f FROM page_results) p JOIN resolutions r ON r.source_path = p.f")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Fresh readings by the resolutions whose files they belong to."""
    p = table(spark, d, "page_results").select("staging_no", "pdf", "page", F.explode("files").alias("source_path")).distinct()
    return table(spark, d, "resolutions").select("res_no", "source_path").join(p, "source_path").select("res_no", "pdf", "page", "staging_no")


@query()
def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """Stored results as JSON documents, one per combination and query."""
    from kosha.operators import metrics

    return tables.results_json(metrics.cleaned(table(spark, d, "rankings")))


@query("SELECT sha256(new_text) AS hash, count(*) AS n, count(DISTINCT pdf) AS n_groups, min(staging_no) AS \"first\", CASE WHEN count(DISTINCT pdf) > 1 THEN 'across' ELSE 'within' END AS kind FROM (SELECT DISTINCT staging_no, pdf, new_text FROM page_results) WHERE trim(new_text) <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_results").select("staging_no", "pdf", "new_text").distinct()
    return quality.duplicates(p, "staging_no", "new_text", "pdf")
