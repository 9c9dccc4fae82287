"""Corpus scans, entities, qrels builders and audits, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.functions import text as tx
from kosha.operators import dictionaries, entities, quality
from kosha.plans.registry import query
from kosha.plans.retrieval_queries import chunks
from kosha.session import stored, table
from kosha.sources import tables

_PATH = r"([0-9]{4})/ครั้งที่ ([0-9]+s?)/([^/]+)\.md$"


@query(f"SELECT res_no, regexp_matches(source_path, '{_PATH}') AND NOT contains(source_path, '.dup') AS real, nullif(regexp_extract(source_path, '{_PATH}', 1), '') AS year, nullif(regexp_extract(source_path, '{_PATH}', 2), '') AS session, nullif(regexp_extract(source_path, '{_PATH}', 3), '') AS stem FROM resolutions")
def corpus_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("source_path")
    return table(spark, d, "resolutions").select("res_no", tables.is_resolution_path(p).alias("real"), tables.path_fields(p).alias("f")).select("res_no", "real", "f.*")


@query("SELECT res_no, year || '/' || session || '/' || title || CASE WHEN r > 1 THEN ' #' || r ELSE '' END AS made_id FROM (SELECT *, row_number() OVER (PARTITION BY year, session, title ORDER BY source_path, res_no) AS r FROM resolutions WHERE year IS NOT NULL AND session IS NOT NULL AND title IS NOT NULL)")
def made_ids(spark: SparkSession, d: str) -> DataFrame:
    """year/session/title, with #N from the second of one title in one meeting."""
    r = table(spark, d, "resolutions").filter("year is not null and session is not null and title is not null")
    n = F.row_number().over(Window.partitionBy("year", "session", "title").orderBy("source_path", "res_no"))
    return r.withColumn("r", n).select("res_no", F.concat("year", F.lit("/"), "session", F.lit("/"), "title", F.when(F.col("r") > 1, F.concat(F.lit(" #"), F.col("r").cast("string"))).otherwise("")).alias("made_id"))


@query("SELECT resolution_id, count(*) AS n FROM resolutions GROUP BY 1 HAVING count(*) > 1 OR resolution_id IS NULL")
def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").groupBy("resolution_id").agg(F.count("*").alias("n")).filter("n > 1 or resolution_id is null")


@query("WITH p AS (SELECT year, substring(md5(resolution_id), 1, 3) AS part, count(*) AS n, sha256(string_agg(resolution_id, chr(10) ORDER BY resolution_id)) AS h FROM resolutions GROUP BY 1, 2) SELECT year, sum(n)::BIGINT AS n, substring(sha256(string_agg(h, '' ORDER BY part)), 1, 16) AS docset FROM p GROUP BY 1")
def manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    return tables.docset_hash(table(spark, d, "resolutions"), "year", "resolution_id")


@query("SELECT title AS query, resolution_id FROM resolutions WHERE title <> ''")
def silver_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").filter("title <> ''").select(F.col("title").alias("query"), "resolution_id")


@query("SELECT res_no, json_extract_string(metadata, '$.source_kind') AS source_kind, json_extract_string(metadata, '$.lang') AS lang, json_extract_string(metadata, '$.n_pages')::INT AS n_pages FROM resolutions")
def metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("metadata", "source_kind string, lang string, n_pages int").alias("m")
    return table(spark, d, "resolutions").select("res_no", m).select("res_no", "m.*")


@query("""WITH k AS (SELECT resolution_id, count(DISTINCT chunk_id) AS n, min(chunk_index) AS low, max(chunk_index) AS high, bool_and(chunk_id = resolution_id || ':' || chunk_index) AS named FROM chunks GROUP BY 1)
SELECT coalesce(k.resolution_id, r.resolution_id) AS resolution_id, CASE WHEN r.resolution_id IS NULL THEN 'contamination' WHEN k.resolution_id IS NULL THEN 'uncovered' WHEN NOT named THEN 'misnamed' WHEN high - low + 1 <> n OR low <> 0 THEN 'gaps' ELSE 'ok' END AS status FROM k FULL JOIN (SELECT DISTINCT resolution_id FROM resolutions) r USING (resolution_id)""")
def audit_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Alignment of the index with the corpus."""
    k = table(spark, d, "chunks").groupBy("resolution_id").agg(F.count_distinct("chunk_id").alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.bool_and(F.col("chunk_id") == F.concat("resolution_id", F.lit(":"), F.col("chunk_index").cast("string"))).alias("named")).withColumn("in_k", F.lit(True))
    r = table(spark, d, "resolutions").select("resolution_id").distinct().withColumn("in_r", F.lit(True))
    status = F.when(F.col("in_r").isNull(), "contamination").when(F.col("in_k").isNull(), "uncovered").when(~F.col("named"), "misnamed").when((F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("low") != 0), "gaps").otherwise("ok")
    return k.join(r, "resolution_id", "full").select("resolution_id", status.alias("status"))


@query("SELECT label, count(*) AS n, count_if(NOT list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS not_finite, count_if(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0) AS zero, count(DISTINCT len(embedding)) AS dims FROM embeddings GROUP BY 1")
def audit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) == 0
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(odd).alias("not_finite"), F.count_if(zero).alias("zero"), F.count_distinct(F.size(v)).alias("dims"))


@query("SELECT DISTINCT query_id, resolution_id FROM qrels ANTI JOIN resolutions USING (resolution_id)")
def audit_qrels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qrels").join(table(spark, d, "resolutions"), "resolution_id", "left_anti").select("query_id", "resolution_id").distinct()


@query("SELECT CASE WHEN url IS NULL THEN 'no url' WHEN urls > 1 THEN 'several urls' WHEN n > 1 THEN 'shared url' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT source_url AS url, count(*) OVER (PARTITION BY source_url) AS n, urls FROM resolutions JOIN (SELECT resolution_id, count(DISTINCT source_url) AS urls FROM resolutions GROUP BY 1) USING (resolution_id)) GROUP BY 1")
def audit_urls(spark: SparkSession, d: str) -> DataFrame:
    """Links missing, shared by several files, or different for one file; shared ones are counted by link first."""
    r = table(spark, d, "resolutions").select("resolution_id", "source_url")
    by_url = r.filter("source_url is not null").groupBy("source_url").agg(F.count("*").alias("n"))
    by_id = r.groupBy("resolution_id").agg(F.count_distinct("source_url").alias("urls"))
    s = F.when(F.col("source_url").isNull(), "no url").when(F.col("urls") > 1, "several urls").when(F.col("n") > 1, "shared url").otherwise("ok")
    return r.join(by_id, "resolution_id").join(by_url, "source_url", "left").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT pdf, page, staging_no, length(new_text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY pdf, page ORDER BY staged_at DESC NULLS LAST, staging_no DESC) AS r FROM page_results) WHERE r = 1")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last reading of each page."""
    return entities.last_write(table(spark, d, "page_results"), ["pdf", "page"], ["staged_at", "staging_no"]).select("pdf", "page", "staging_no", F.length("new_text").cast("bigint").alias("n_chars"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type FROM events), c AS (SELECT user_id, ts AS at, max(event_id) AS click FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2)
SELECT e.event_id, CASE WHEN epoch(e.ts) - epoch(c.at) <= 3600 THEN c.click END AS near_event FROM (SELECT * FROM e WHERE event_type = (SELECT max(event_type) FROM events)) e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.at""")
def nearest_preceding(spark: SparkSession, d: str) -> DataFrame:
    """For each event of the last type the same user's latest one of the first type within an hour before."""
    e = table(spark, d, "events")
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    left = e.filter(F.col("event_type") == kinds["b"]).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    right = e.filter(F.col("event_type") == kinds["a"]).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("event"))
    return entities.nearest_before(left, right, ["user_id"], "at", 3600e6, "event").select("event_id", "near_event")


_CODES = r"list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(translate({0}, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '((?:รหัสนักศึกษา|รหัสประจำตัวนักศึกษา|student ID|student no\.)[ :]{{0,5}})[0-9]{{8}}', '\1________', 'g'), '([0-9]{{8}})', '<\1>', 'g'), '<([0-9]{{8}})>\s*[A-Z]', 1)))"


@query(f"SELECT doc_id, {_CODES.format('text')} AS codes FROM documents WHERE text IS NOT NULL")
def course_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", entities.course_codes(F.col("text")).alias("codes"))


@query("SELECT f AS tag, count(*) AS n, count(DISTINCT res_no) AS n_docs FROM (SELECT res_no, unnest(faculties) AS f FROM resolutions) WHERE f IS NOT NULL GROUP BY 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "resolutions").select("res_no", F.explode("faculties").alias("tag")).filter("tag is not null")
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("res_no").alias("n_docs"))


@query("SELECT count(*) AS n FROM resolutions WHERE coalesce(len(list_filter(faculties, lambda x: x IS NOT NULL)), 0) = 0")
def untagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").filter(F.coalesce(F.size(F.filter("faculties", lambda x: x.isNotNull())), F.lit(0)) <= 0).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT res_no, unnest(programs) AS p FROM resolutions), f AS (SELECT DISTINCT res_no, unnest(faculties) AS f FROM resolutions), b AS (SELECT p, f FROM (SELECT * FROM p WHERE p IN (SELECT canonical FROM programs)) LEFT JOIN (SELECT * FROM f WHERE f IN (SELECT canonical FROM faculties)) USING (res_no)),
n AS (SELECT p, f, count(*) AS votes FROM b WHERE f IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(votes) OVER (PARTITION BY p) AS total, row_number() OVER (PARTITION BY p ORDER BY votes DESC, f) AS r FROM n)
SELECT x.p AS program, t.f AS faculty, t.votes, t.total::BIGINT AS total, round(votes::DOUBLE / total, 6) AS share, CASE WHEN votes IS NULL THEN 'no_evidence' WHEN round(votes::DOUBLE / total, 6) >= 0.6 AND votes >= 2 THEN 'resolved' ELSE 'ambiguous' END AS status FROM (SELECT DISTINCT p FROM b) x LEFT JOIN t ON t.p = x.p AND t.r = 1""")
def vote_classify(spark: SparkSession, d: str) -> DataFrame:
    """The faculty of each programme, by the documents tagged with both."""
    r = table(spark, d, "resolutions")
    p = r.select("res_no", F.explode("programs").alias("program")).distinct().join(F.broadcast(table(spark, d, "programs").select(F.col("canonical").alias("program"))), "program", "left_semi")  # reference lists of fixed size
    f = r.select("res_no", F.explode("faculties").alias("faculty")).distinct().join(F.broadcast(table(spark, d, "faculties").select(F.col("canonical").alias("faculty"))), "faculty", "left_semi")
    return entities.votes(p.join(f, "res_no", "left"), "program", "faculty")


@query("SELECT field, count(*) AS n, min(program_id) AS first FROM programs GROUP BY 1 HAVING count(DISTINCT degree) = 1")
def unique_name_gate(spark: SparkSession, d: str) -> DataFrame:
    """Fields that one degree alone has."""
    return table(spark, d, "programs").groupBy("field").agg(F.count("*").alias("n"), F.min("program_id").alias("first"), F.count_distinct("degree").alias("d")).filter("d = 1").drop("d")


@query("""WITH a AS (SELECT canonical, unnest(aliases) AS alias FROM faculties), u AS (SELECT canonical, canonical AS name FROM faculties UNION ALL SELECT canonical, alias FROM a WHERE alias IS NOT NULL)
SELECT u.canonical, count(*) AS n FROM (SELECT unnest(faculties) AS t FROM resolutions) JOIN u ON t = u.name GROUP BY 1""")
def alias_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "faculties")
    names = f.select("canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).filter("name is not null")
    tags = table(spark, d, "resolutions").select(F.explode("faculties").alias("name"))
    return tags.join(F.broadcast(names), "name").groupBy("canonical").agg(F.count("*").alias("n"))  # a reference list of fixed size


@query(r"""WITH x AS (SELECT res_no, regexp_extract_all(raw_text, '\(ดูภาคผนวก ([A-H])\)', 1) AS c FROM resolutions) SELECT res_no, len(c) AS n, len(list_distinct(c)) AS n_distinct, CASE WHEN len(c) = 0 THEN NULL ELSE round(len(list_filter(c, lambda y: y <= 'D'))::DOUBLE / len(c), 6) END AS valid_share FROM x""")
def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Annexes cited in each text and the share of those that exist (A to D); undefined, not 0, without any."""
    c = F.regexp_extract_all("raw_text", F.lit(r"\(ดูภาคผนวก ([A-H])\)"), F.lit(1))
    x = table(spark, d, "resolutions").select("res_no", c.alias("c"))
    return x.select("res_no", F.size("c").cast("bigint").alias("n"), F.size(F.array_distinct("c")).cast("bigint").alias("n_distinct"), F.round(F.try_divide(F.size(F.filter("c", lambda y: y <= "D")).cast("double"), F.size("c").cast("double")), 6).alias("valid_share"))


@query("SELECT query_id, res_no, substring(title, greatest(strpos(title, entity) - 40, 1), strpos(title, entity) - greatest(strpos(title, entity) - 40, 1) + length(entity) + 40) AS line FROM resolutions JOIN queries ON entity IS NOT NULL AND entity <> '' AND contains(title, entity)")
def kwic(spark: SparkSession, d: str) -> DataFrame:
    """Entities in titles with forty characters to either side."""
    q, r = table(spark, d, "queries").select("query_id", "entity"), table(spark, d, "resolutions").select("res_no", "title")
    found = dictionaries.mentions(r, "res_no", "title", q, "entity", flat=False, alone=False).join(q, "entity").join(r, "res_no")
    return found.select("query_id", "res_no", entities.kwic(F.col("title"), F.col("entity")).alias("line"))


@query("""WITH t AS (SELECT query_id, entity_type, entity, 'เรื่อง' AS m FROM queries), e AS (SELECT q.query_id, count(DISTINCT r.year || '/' || r.session) AS n_meetings, count(*) AS n_docs FROM queries q JOIN resolutions r ON q.entity <> '' AND contains(r.title, q.entity) GROUP BY 1) SELECT * FROM e WHERE n_docs >= 2""")
def qrels_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose entity is named by at least two titles, with the number of meetings."""
    q = table(spark, d, "queries").select("query_id", "entity")
    r = table(spark, d, "resolutions").select("res_no", "title", F.concat("year", F.lit("/"), "session").alias("meeting"))
    found = dictionaries.mentions(r, "res_no", "title", q, "entity", flat=False, alone=False).join(r.select("res_no", "meeting"), "res_no").join(q, "entity")
    return found.groupBy("query_id").agg(F.count_distinct("meeting").alias("n_meetings"), F.count("*").alias("n_docs")).filter("n_docs >= 2")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.res_no AS x, b.res_no AS y FROM (SELECT res_no, sha256(raw_text) AS h FROM resolutions) a JOIN (SELECT res_no, sha256(raw_text) AS h FROM resolutions) b ON a.h = b.h) SELECT x AS node, min(y) AS label FROM e GROUP BY x HAVING count(*) > 1""")
def union_find(spark: SparkSession, d: str) -> DataFrame:
    """Components over equal texts: every row is linked to the least row of its hash."""
    r = table(spark, d, "resolutions").select("res_no", F.sha2("raw_text", 256).alias("h"))
    least = r.groupBy("h").agg(F.min("res_no").alias("first"), F.count("*").alias("n")).filter("n > 1")
    edges = r.join(least, "h").filter("res_no <> first").select("res_no", "first")
    return quality.components(edges, "res_no", "first", stored)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("WITH c AS (SELECT chunk_id, first(text) AS text, resolution_id FROM chunks GROUP BY chunk_id, resolution_id) SELECT r.res_no, count(c.chunk_id) AS n_chunks, count_if(contains(regexp_replace(r.raw_text, '[ \t\n\r]+', ' ', 'g'), trim(regexp_replace(c.text, '[ \t\n\r]+', ' ', 'g'), ' '))) AS n_found FROM resolutions r JOIN c USING (resolution_id) GROUP BY 1")
def chunk_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stand in the text of their resolution, white space aside."""
    both = table(spark, d, "resolutions").select("res_no", "resolution_id", "raw_text").join(chunks(spark, d).select("chunk_id", "resolution_id", "text"), "resolution_id")
    return both.groupBy("res_no").agg(F.count("chunk_id").alias("n_chunks"), F.count_if(tx.verify_span(F.col("text"), F.col("raw_text"))).alias("n_found"))
