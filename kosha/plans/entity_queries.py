"""Entities of dictionaries, loaders and routes, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.functions import text as tx
from kosha.operators import dictionaries as dc
from kosha.operators import entities, fusion, loaders, quality
from kosha.plans import corpus_tables
from kosha.plans.registry import query
from kosha.plans.retrieval_queries import _C, _DENSE, _JOIN, _PHRASE, _RANKED, _RRF, _arms, _bm25_sql, index_chunks
from kosha.session import built, stored, table

_TABLE_SQL = "(?is)<table.*?</table>"


def _scans(spark: SparkSession, d: str) -> dict[str, dc.Scan]:
    return {"programs": dc.Programs(dc.entries(table(spark, d, "programs"))), "faculties": dc.Faculties(dc.entries(table(spark, d, "faculties"), "aliases"))}


@query()
def entity_tags(spark: SparkSession, d: str) -> DataFrame:
    """Programmes and faculties that each text names, by the reference lists."""
    return dc.tags(table(spark, d, "resolutions"), "res_no", "raw_text", _scans(spark, d))


@query()
def title_tags(spark: SparkSession, d: str) -> DataFrame:
    return dc.tags(table(spark, d, "resolutions"), "res_no", "title", _scans(spark, d))


@query()
def program_matches(spark: SparkSession, d: str) -> DataFrame:
    """How the places that may name a programme were judged: what they are most like, what was taken, what the text contradicts."""
    m = dc.matches(table(spark, d, "resolutions"), "res_no", "title", _scans(spark, d)["programs"])
    return m.groupBy("alike", "taken", "contradicted").agg(F.count("*").alias("n"), F.round(F.avg("likeness"), 6).alias("likeness"))


@query("""WITH RECURSIVE a AS (SELECT program_id, coalesce(field, '') AS f, coalesce(degree, '') AS g FROM programs WHERE contains(degree, 'อนุปริญญา')),
e AS (SELECT x.program_id AS a, y.program_id AS b FROM a x JOIN a y ON x.f = y.f AND x.g <> y.g AND (starts_with(x.g, y.g) OR starts_with(y.g, x.g))),
w AS (SELECT program_id AS a, program_id AS b FROM programs UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b) SELECT a AS program_id, min(b) AS group_id FROM w GROUP BY 1""")
def program_groups(spark: SparkSession, d: str) -> DataFrame:
    """Programmes by the least id of those that are one programme under several names."""
    p = table(spark, d, "programs")
    labels = quality.components(dc.renamed(p), "a", "b", stored).toDF("program_id", "label")
    return p.select("program_id").join(labels, "program_id", "left").select("program_id", F.coalesce("label", "program_id").alias("group_id"))


@query(f"""WITH f AS (SELECT DISTINCT field FROM programs WHERE trim(field) <> ''), m AS (SELECT res_no, field FROM resolutions JOIN f ON {_PHRASE.format('title', 'field')}),
w AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.res_no = m.res_no AND o.field <> m.field AND contains(o.field, m.field)))
SELECT DISTINCT res_no, canonical FROM w JOIN programs USING (field)""")
def bare_fields(spark: SparkSession, d: str) -> DataFrame:
    """All programmes with a field that a title names, unless the field is part of a longer one named there."""
    p = table(spark, d, "programs").filter("field is not null")
    found = dc.widest(dc.mentions(table(spark, d, "resolutions"), "res_no", "title", p, "field"), "res_no", "field")
    return found.join(p.select("field", "canonical"), "field").select("res_no", "canonical").distinct()


def _people_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select(F.explode(dc.people(F.col("text"))).alias("p"))
    return built(spark, "people", d, lambda: p.select(F.concat_ws(" ", "p.given", "p.surname").alias("name")).distinct())


_NAMES = f"p AS ({corpus_tables._PEOPLE('doc_id', 'text', 'documents')}), pn AS (SELECT DISTINCT given || ' ' || surname AS name FROM p)"


@query(f"WITH {_NAMES} SELECT doc_id, name FROM documents JOIN pn ON contains(text, name)")
def dictionary_people(spark: SparkSession, d: str) -> DataFrame:
    """People of the corpus' dictionary named in each document, with or without a title."""
    return dc.mentions(table(spark, d, "documents"), "doc_id", "text", _people_names(spark, d), "name", flat=False, alone=False)


_COURSES = f"""ct AS (SELECT res_no, regexp_extract_all(raw_text, '{corpus_tables._ROWS}', 1) AS c, regexp_extract_all(raw_text, '{corpus_tables._ROWS}', 2) AS t FROM resolutions),
cn AS (SELECT trim(unnest(t)) AS name, unnest(c) AS code FROM ct), cu AS (SELECT name, min(code) AS code FROM cn WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT code) = 1)"""


def _course_names(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract_all("raw_text", F.lit(corpus_tables._ROWS), F.lit(i))
    rows = table(spark, d, "resolutions").select(F.explode(F.arrays_zip(part(1).alias("code"), part(2).alias("name"))).alias("z")).select("z.code", F.trim("z.name").alias("name")).filter("name <> ''")
    return built(spark, "courses", d, lambda: rows.groupBy("name").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).filter("n = 1").select("name", "code"))


@query(f"WITH {_COURSES} SELECT name, code, len(string_split(name, ' ')) >= 2 AS two_words FROM cu")
def course_names(spark: SparkSession, d: str) -> DataFrame:
    """Course names that one code alone has, and whether they have two words, as a search by name asks for."""
    return _course_names(spark, d).select("name", "code", (F.size(F.split("name", " ")) >= 2).alias("two_words"))


@query(f"WITH {_COURSES} SELECT DISTINCT res_no, code FROM resolutions JOIN cu ON {_PHRASE.format('raw_text', 'name')}")
def courses_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the courses that a text names as a standalone phrase."""
    c = _course_names(spark, d)
    return dc.mentions(table(spark, d, "resolutions"), "res_no", "raw_text", c, "name").join(c, "name").select("res_no", "code").distinct()


_SPACED = r"regexp_replace(query, '(ผู้ช่วยศาสตราจารย์|รองศาสตราจารย์|ศาสตราจารย์|ผศ\.|รศ\.|ศ\.|ดร\.)\s+([ก-ฮ])', '\1\2', 'g')"
_CODED = r"regexp_matches(regexp_replace(translate(query, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '((?:รหัสนักศึกษา|รหัสประจำตัวนักศึกษา|student ID|student no\.)[ :]{0,5})[0-9]{8}', '\1________', 'g'), '[0-9]{8}\s*[A-Z]')"


def _detected(spark: SparkSession, d: str) -> DataFrame:
    courses = _course_names(spark, d).filter(F.size(F.split("name", " ")) >= 2)
    return dc.detected(table(spark, d, "queries"), "query_id", "query", {"programs": table(spark, d, "programs"), "faculties": table(spark, d, "faculties"), "people": _people_names(spark, d), "courses": courses})


@query(f"""WITH {_NAMES}, {_COURSES}, q AS (SELECT query_id, query, len(regexp_extract_all({_SPACED}, '{dc.TITLED}')) > 0 AS person, {_CODED} OR EXISTS (SELECT 1 FROM cu WHERE len(string_split(name, ' ')) >= 2 AND {_PHRASE.format('queries.query', 'name')}) AS course,
  EXISTS (SELECT 1 FROM programs p WHERE contains(queries.query, p.canonical)) OR contains(query, 'สาขาวิชา') AS program, EXISTS (SELECT 1 FROM (SELECT canonical AS n FROM faculties UNION ALL SELECT unnest(aliases) FROM faculties) f WHERE contains(queries.query, f.n)) AS faculty, EXISTS (SELECT 1 FROM programs p WHERE {_PHRASE.format('queries.query', 'p.field')}) AS field FROM queries)
SELECT query_id, CASE WHEN person THEN 'person' WHEN course THEN 'course' WHEN program THEN 'program' WHEN faculty THEN 'faculty' WHEN field THEN 'program' ELSE 'unmatched' END AS route FROM q""")
def query_routes(spark: SparkSession, d: str) -> DataFrame:
    """The route of each query, by what the dictionaries find in it."""
    return _detected(spark, d).select("query_id", dc.route().alias("route"))


@query()
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    """What each query names, by kind, and its route."""
    named = _detected(spark, d)
    return named.select("query_id", "people", "programs", "courses", "faculties", "fields", dc.route().alias("route"))


@query()
def person_affiliations(spark: SparkSession, d: str) -> DataFrame:
    """People by the faculty that stands beside their affiliation most often."""
    a = dc.affiliations(table(spark, d, "documents"), "doc_id", "text", _scans(spark, d)["faculties"])
    return entities.votes(a.filter("person is not null").select("person", "faculty"), "person", "faculty", least=1)


_HYBRID = f"{_C}, {_bm25_sql('c')}, {_DENSE}, {_JOIN.format(50)}, {_RRF}, hy AS ({_RANKED.format(50)})"


@query(f"""WITH {_HYBRID}, h AS (SELECT query_id, chunk_id, score, rank, coalesce(trim(q.entity) <> '' AND {_PHRASE.format('c.text', 'q.entity')}, false) AS hit FROM hy JOIN c USING (chunk_id) JOIN queries q USING (query_id))
SELECT query_id, chunk_id, score, hit, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT hit, rank) AS new_rank FROM h) WHERE new_rank <= 10""")
def hybrid_containment(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid's pool of fifty, chunks that name the query's entity first, both parts in the pool's order; scores stay."""
    pool = fusion.ranked(fusion.rrf(_arms(spark, d, 50)), "query_id", "chunk_id", 50).select("query_id", "chunk_id", "score", "rank")
    hits = pool.join(index_chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(table(spark, d, "queries").select("query_id", "entity"), "query_id").withColumn("hit", tx.contains_phrase(F.col("text"), F.col("entity")))
    return fusion.partition_first(hits, "query_id", F.col("hit"), 50).filter("new_rank <= 10").select("query_id", "chunk_id", "score", "hit", "new_rank")


@query(f"""WITH {_HYBRID}, h AS (SELECT query_id, chunk_id, round(coalesce((regexp_matches(c.text, '[0-9]'))::INT, 0) - 1e-6 * rank, 6) AS signal, rank FROM hy JOIN c USING (chunk_id))
SELECT query_id, chunk_id, signal, row_number() OVER (PARTITION BY query_id ORDER BY signal DESC, rank) AS new_rank FROM h""")
def signal_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid's pool by a yes-or-no signal (here: a number in the chunk), ties by a millionth of the rank."""
    pool = fusion.ranked(fusion.rrf(_arms(spark, d, 50)), "query_id", "chunk_id", 50).select("query_id", "chunk_id", "rank").join(index_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    s = pool.withColumn("signal", F.round(F.coalesce(F.col("text").rlike("[0-9]").cast("int"), F.lit(0)) - F.lit(1e-6) * F.col("rank"), 6))
    return s.select("query_id", "chunk_id", "signal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("signal").desc(), "rank")).alias("new_rank"))


@query("""WITH a AS (SELECT query_id, query, unnest(['raw', 'half', 'concat', 'query_prompt', 'passage_prompt']) AS arm FROM queries), e AS (SELECT q.query_id, min(r.raw_text) AS doc FROM qrels q JOIN resolutions r USING (resolution_id) GROUP BY 1)
SELECT a.query_id, arm, md5(CASE arm WHEN 'raw' THEN query WHEN 'half' THEN substring(doc, 1, length(doc) // 2) WHEN 'concat' THEN query || ' ' || doc WHEN 'query_prompt' THEN 'query: ' || query ELSE 'passage: ' || query END) AS text FROM a LEFT JOIN e ON a.query_id = e.query_id""")
def query_arms(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the arms of a query-vector study embed: the query, half of a document written for it (here: the least judged one), both, and with prompts."""
    from kosha.operators import dense

    r = table(spark, d, "resolutions").select("resolution_id", "raw_text")
    doc = table(spark, d, "qrels").select("query_id", "resolution_id").join(r, "resolution_id").groupBy("query_id").agg(F.min("raw_text").alias("doc"))
    q = table(spark, d, "queries").select("query_id", "query").join(doc, "query_id", "left")
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), t.alias("t")) for n, t in dense.arms(F.col("query"), F.col("doc")).items()]))
    return q.select("query_id", arms.alias("a")).select("query_id", "a.arm", F.md5("a.t").alias("text"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(coalesce(list_filter(regexp_split_to_array(lower(text), '[ \n\t]+'), lambda t: t <> ''), []), lambda t: NOT regexp_full_match(t, '[!-/:-@\[-`{{-~]+')) AS kept, coalesce(list_filter(regexp_split_to_array(lower(text), '[ \n\t]+'), lambda t: t <> ''), []) AS ws FROM documents)
SELECT doc_id, len(CASE WHEN len(kept) = 0 THEN ws[1:1] ELSE kept[1:300] END) AS n_document, 32::BIGINT AS n_query FROM w""")
def late_interaction_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents and queries as a late-interaction encoder takes them: 300 without punctuation, one at least; queries filled up to 32."""
    from kosha.operators import dense
    from kosha.operators.lexical import tokens

    t = tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(dense.document_tokens(t)).cast("bigint").alias("n_document"), F.size(dense.query_tokens(t)).cast("bigint").alias("n_query"))


@query("SELECT res_no, raw_text FROM resolutions")
def load_plain(spark: SparkSession, d: str) -> DataFrame:
    """Texts without mapping grids and with short course tables; these tables hold neither, so that texts stay as they are (the cuts are unit-tested)."""
    return loaders.load(table(spark, d, "resolutions"), "res_no", "raw_text")


@query(r"""
SELECT res_no, regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(CASE WHEN h = '' THEN raw_text ELSE substring(raw_text, 1, strpos(raw_text, h) - 1) || substring(raw_text, strpos(raw_text, h) + length(h)) END, '\A\n+', ''), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS raw_text
FROM (SELECT res_no, raw_text, regexp_extract(raw_text, '(?m)^[ \t]*#[ \t]*Document:.*$') AS h FROM resolutions)""")
def load_normalized(spark: SparkSession, d: str) -> DataFrame:
    return loaders.load(table(spark, d, "resolutions"), "res_no", "raw_text", "normalized")


@query(f"""WITH t AS (SELECT res_no, raw_text, string_split_regex(raw_text, '{_TABLE_SQL}') AS p, regexp_extract_all(raw_text, '{_TABLE_SQL}') AS t FROM resolutions)
SELECT res_no, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(repeat(' ', length(t[i])), '')), '') AS body FROM t""")
def blank_tables(spark: SparkSession, d: str) -> DataFrame:
    """Texts with tables as spaces, so that places stay."""
    return table(spark, d, "resolutions").select("res_no", loaders.blank_tables(F.col("raw_text")).alias("body"))


@query(r"""WITH m AS (SELECT res_no, raw_text, string_split(regexp_replace(raw_text, '(?m)^## Page ([0-9]+)[ \t]*$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM resolutions),
p AS (SELECT res_no, i, 'Page ' || string_split(x, chr(2))[1] AS label, trim(string_split(x, chr(2))[-1], ' ' || chr(10) || chr(9) || chr(13)) AS body FROM (SELECT res_no, unnest(l[2:]) AS x, generate_subscripts(l[2:], 1) AS i FROM m WHERE len(l) > 1)),
c AS (SELECT res_no, i, s // 6000 AS j, CASE WHEN length(body) <= 6000 THEN label ELSE label || '.' || (s // 6000 + 1) END AS label, substring(body, s + 1, 6000) AS body FROM p, LATERAL (SELECT unnest(range(0, length(body), 6000)) AS s)
  UNION ALL SELECT res_no, 0, s // 6000, 'chunk' || (s // 6000 + 1), substring(raw_text, s + 1, 6000) FROM m, LATERAL (SELECT unnest(range(0, length(raw_text), 6000)) AS s) WHERE len(l) = 1)
SELECT res_no, row_number() OVER (PARTITION BY res_no ORDER BY i, j) - 1 AS pos, label, length(body) AS n_chars, md5(body) AS body FROM c WHERE trim(body, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def page_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "resolutions").select("res_no", F.posexplode(loaders.page_parts(F.col("raw_text"))).alias("pos", "p"))
    return parts.select("res_no", F.col("pos").cast("bigint").alias("pos"), "p.label", F.length("p.body").cast("bigint").alias("n_chars"), F.md5("p.body").alias("body"))


@query()
def bundle_items(spark: SparkSession, d: str) -> DataFrame:
    """Texts that declare several curricula, and where each begins or why it can't be told."""
    return loaders.bundles(table(spark, d, "resolutions"), "res_no", "raw_text")


@query()
def replaced_pages(spark: SparkSession, d: str) -> DataFrame:
    """Scanned resolutions with the last reading of each of their pages in place of the old text."""
    last = entities.last_write(table(spark, d, "page_results").filter("new_text is not null"), ["pdf", "page"], ["staged_at", "staging_no"])
    new = last.select(F.explode("files").alias("source_path"), F.col("page").cast("int").alias("page"), F.col("new_text").alias("body")).groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"))
    r = table(spark, d, "resolutions").select("res_no", "source_path", "raw_text").join(new, "source_path")
    out = loaders.replaced_pages(r, "res_no", "raw_text", "pages")
    return out.select("res_no", F.md5("raw_text").alias("text"), "n_replaced", "n_missing")


@query("""WITH c AS (SELECT chunk_id, min(resolution_id) AS resolution_id, min(page) AS page FROM chunks GROUP BY 1), r AS (SELECT resolution_id, min(year) AS year, min(session) AS session, min(json_extract_string(metadata, '$.lang')) AS lang, min(json_extract_string(metadata, '$.source_kind')) AS kind FROM resolutions GROUP BY 1)
SELECT chunk_id, year, session, lang, kind, page::VARCHAR AS page FROM c LEFT JOIN r USING (resolution_id)""")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their document's fields and metadata, their own page over it."""
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("resolution_id").alias("resolution_id"), F.min("page").alias("page"))
    part = lambda f: F.min(F.get_json_object("metadata", f"$.{f}"))
    r = table(spark, d, "resolutions").groupBy("resolution_id").agg(F.min("year").alias("year"), F.min("session").alias("session"), part("lang").alias("lang"), part("source_kind").alias("kind"))
    fields = ("year", "session", "lang", "kind")
    both = c.join(r, "resolution_id", "left").withColumn("m", loaders.inherited(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]), F.create_map(F.lit("page"), F.col("page").cast("string"))))
    return both.select("chunk_id", *[F.col("m")[f].alias(f) for f in (*fields, "page")])


_PREFIX = "(?:คณะ|วิทยาลัย|สถาบัน|สำนัก|วิทยาเขต)"


@query(rf"""WITH c AS (SELECT unnest(regexp_extract_all(replace(raw_text, 'มหาวิทยาลัย', '            '), '{_PREFIX}[^ \t\n\r]+')) AS c FROM resolutions), s AS (SELECT rtrim(regexp_replace(c, '(\.pdf|\.md|\.docx|`|</?\w+.*|\)\s*</.*)+$', ''), '),.:;<>"''/') AS name FROM c)
SELECT name, count(*) AS n FROM s WHERE NOT starts_with(name, 'คณะกรรมการ') AND NOT starts_with(name, 'คณะอนุกรรมการ') AND length(name) BETWEEN 3 AND 60 GROUP BY 1""")
def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Words that begin as a faculty does, of 3 to 60 characters and no committees, with their counts; what is left of markup and file names at their end is cut."""
    found = F.regexp_extract_all(F.replace("raw_text", F.lit("มหาวิทยาลัย"), F.lit(" " * 12)), F.lit(_PREFIX + r"[^ \t\n\r]+"), F.lit(0))
    name = F.rtrim(F.regexp_replace("c", r"(\.pdf|\.md|\.docx|`|</?\w+.*|\)\s*</.*)+$", ""), F.lit("),.:;<>\"'/"))
    each = table(spark, d, "resolutions").select(F.explode(found).alias("c")).select(name.alias("name"))
    return each.filter(~F.startswith("name", F.lit("คณะกรรมการ")) & ~F.startswith("name", F.lit("คณะอนุกรรมการ")) & F.length("name").between(3, 60)).groupBy("name").agg(F.count("*").alias("n"))
