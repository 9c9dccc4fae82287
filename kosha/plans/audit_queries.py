"""Audits, candidates for judgements, and studies over answers and decisions, over whole tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.functions import text as tx
from kosha.operators import audits, dictionaries, entities, lexical, metrics, stats
from kosha.plans import corpus_tables
from kosha.plans.corpus_queries import _CODES
from kosha.plans.ranking_queries import _BASE, _BOOT, _DIFFS, _PER, N_BOOT, _diffs, _scores
from kosha.plans.registry import query
from kosha.plans.retrieval_queries import _C, _PHRASE, _bm25_sql, _postings, index_chunks
from kosha.plans.text_queries import _SUBJECT
from kosha.session import built, stored, table
from kosha.sources import tables

_FAMILY = "split_part(combination_id, '-', 1)"


@query(f"""WITH {_BASE}, hh AS (SELECT DISTINCT combination_id, resolution_id FROM r WHERE resolution_id IS NOT NULL), x AS (SELECT DISTINCT split_part(resolution_id, '/', 1) AS name, resolution_id FROM chunks UNION SELECT DISTINCT 'all', resolution_id FROM chunks),
n AS (SELECT combination_id, count(*) AS n FROM hh GROUP BY 1), f AS (SELECT combination_id, name, count(*) AS m FROM hh JOIN x USING (resolution_id) GROUP BY 1, 2), gg AS (SELECT combination_id, count(*) AS fits, min(name) AS single FROM f JOIN n USING (combination_id) WHERE m = n GROUP BY 1)
SELECT c.combination_id, CASE WHEN coalesce(fits, 0) = 1 THEN single END AS name, CASE WHEN coalesce(fits, 0) = 1 THEN 'elimination' WHEN coalesce(fits, 0) = 0 THEN 'none' ELSE 'ambiguous' END AS how FROM (SELECT DISTINCT combination_id FROM r) c LEFT JOIN gg USING (combination_id)""")
def result_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Which index each combination's results came from: the whole one or that of one year."""
    ids = table(spark, d, "chunks").select("resolution_id").distinct()
    indexes = ids.select(F.split("resolution_id", "/")[0].alias("name"), "resolution_id").union(ids.select(F.lit("all"), "resolution_id"))
    return audits.attributed(metrics.cleaned(table(spark, d, "rankings")), indexes, "combination_id", "resolution_id", "name")


@query("""WITH c AS (SELECT DISTINCT combination_id, resolution_id FROM rankings WHERE resolution_id IS NOT NULL), k AS (SELECT DISTINCT resolution_id FROM chunks), r AS (SELECT DISTINCT resolution_id FROM resolutions)
SELECT combination_id, count(*) AS n_docs, count(*) FILTER (k.resolution_id IS NULL) AS not_in_index, count(*) FILTER (r.resolution_id IS NULL) AS not_in_corpus FROM c LEFT JOIN k USING (resolution_id) LEFT JOIN r USING (resolution_id) GROUP BY 1""")
def stale_results(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the results of each combination that the index or the corpus no longer holds."""
    c = table(spark, d, "rankings").filter("resolution_id is not null").select("combination_id", "resolution_id").distinct()
    k = table(spark, d, "chunks").select("resolution_id").distinct().withColumn("k", F.lit(1))
    r = table(spark, d, "resolutions").select("resolution_id").distinct().withColumn("r", F.lit(1))
    both = c.join(k, "resolution_id", "left").join(r, "resolution_id", "left")
    return both.groupBy("combination_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("k").isNull()).alias("not_in_index"), F.count_if(F.col("r").isNull()).alias("not_in_corpus"))


@query(f"""WITH c AS (SELECT DISTINCT combination_id FROM rankings), x AS (SELECT DISTINCT split_part(resolution_id, '/', 1) AS year FROM chunks), y AS (SELECT DISTINCT combination_id, split_part(resolution_id, '/', 1) AS year FROM rankings WHERE resolution_id IS NOT NULL)
SELECT c.combination_id, list_sort((SELECT coalesce(list(x.year), []) FROM x WHERE x.year NOT IN (SELECT y.year FROM y WHERE y.combination_id = c.combination_id))) AS unused_years FROM c""")
def unused_parts(spark: SparkSession, d: str) -> DataFrame:
    """Years of the index that a combination's results never touch."""
    x = table(spark, d, "chunks").select(F.split("resolution_id", "/")[0].alias("year")).distinct().agg(F.collect_list("year").alias("all"))  # as many as there are years
    y = table(spark, d, "rankings").groupBy("combination_id").agg(F.collect_set(F.split("resolution_id", "/")[0]).alias("used"))
    return y.join(F.broadcast(x)).select("combination_id", F.array_sort(F.array_except("all", "used")).alias("unused_years"))


@query("""WITH v AS (SELECT vec_id // 8 AS doc, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT doc, count(DISTINCT len(e)) AS sizes, bool_or(list_bool_or(list_transform(e, lambda x: NOT isfinite(x)))) AS odd, bool_or(abs(sqrt(list_dot_product(e, e)) - 1) > 1e-3) AS off FROM v GROUP BY 1), n AS (SELECT count(*) AS n, count_if(sizes > 1) AS mixed, count_if(odd) AS odd, count_if(off) AS off FROM g)
SELECT 'not empty' AS "check", n, 0 AS bad FROM n UNION ALL SELECT 'one size', n, mixed FROM n UNION ALL SELECT 'finite', n, odd FROM n UNION ALL SELECT 'length 1', n, off FROM n UNION ALL SELECT 'aligned', n, NULL FROM n""")
def vector_document_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("doc")).agg(F.collect_list("embedding").alias("v"))
    return audits.vector_documents(docs, "doc", "v")


@query(f"""WITH {_C}, {_bm25_sql('c')} SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_id, df FROM i""")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Terms by number, in order: ranges of terms are numbered on their own and moved by what comes before, so that no task holds all."""
    t = _postings(spark, d).groupBy("term").agg(F.count("*").alias("df"))
    return tables.numbered(t, "term", "term_id")


@query(f"""WITH {_C}, {_bm25_sql('c')}, s AS (SELECT count(*) AS n_postings, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT term) AS n_terms, count_if(weight = 0) AS zero_weights FROM w), g AS (SELECT count(*) AS n FROM c WHERE trim(text, ' ' || chr(10) || chr(9)) <> '')
SELECT n_postings, n_chunks, n_terms, zero_weights, (SELECT n FROM g) - n_chunks AS chunks_without_postings, 0::BIGINT AS double_postings FROM s""")
def postings_checks(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings against the chunks: counts, weights of 0, chunks with words but no postings, postings given twice."""
    p = _postings(spark, d)
    one = p.agg(F.count("*").alias("n_postings"), F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("term").alias("n_terms"), F.count_if(F.col("weight") == 0).alias("zero_weights"))
    words = index_chunks(spark, d).filter(F.size(lexical.tokens(F.col("text"))) > 0).select("chunk_id")
    none = words.join(p.select("chunk_id").distinct(), "chunk_id", "left_anti").agg(F.count("*").alias("chunks_without_postings"))
    twice = p.groupBy("term", "chunk_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("double_postings"))
    return one.join(none).join(twice)  # three tables of one row


@query("""WITH c AS (SELECT resolution_id, count(DISTINCT chunk_id) AS n, max(chunk_index) + 1 AS span FROM chunks GROUP BY 1), r AS (SELECT resolution_id, min(length(raw_text)) AS l FROM resolutions GROUP BY 1)
SELECT CASE WHEN c.resolution_id IS NULL THEN 'new: not indexed' WHEN r.resolution_id IS NULL THEN 'gone: still indexed' WHEN n <> span THEN 'half written' WHEN l IS NULL OR l = 0 THEN 'empty: still indexed' ELSE 'current' END AS status, count(*) AS n FROM c FULL JOIN r USING (resolution_id) GROUP BY 1""")
def index_drift(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the state of their chunks against the corpus."""
    c = table(spark, d, "chunks").groupBy("resolution_id").agg(F.count_distinct("chunk_id").alias("n"), (F.max("chunk_index") + 1).alias("span"), F.lit(1).alias("c"))
    r = table(spark, d, "resolutions").groupBy("resolution_id").agg(F.min(F.length("raw_text")).alias("l"), F.lit(1).alias("r"))
    status = F.when(F.col("c").isNull(), "new: not indexed").when(F.col("r").isNull(), "gone: still indexed").when(F.col("n") != F.col("span"), "half written").when(F.col("l").isNull() | (F.col("l") == 0), "empty: still indexed").otherwise("current")
    return c.join(r, "resolution_id", "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT staging_no, pdf, page, new_text, unnest(files) AS f FROM page_results WHERE new_text IS NOT NULL), n AS (SELECT staging_no, list_distinct(regexp_extract_all(new_text, '[0-9]{3,}')) AS said, regexp_extract_all(string_agg(r.raw_text, ' ' ORDER BY r.res_no), '[0-9]{3,}') AS known FROM f JOIN resolutions r ON r.source_path = f.f GROUP BY staging_no, new_text)
SELECT staging_no, len(said) AS n_numbers, len(list_filter(said, lambda x: NOT list_contains(coalesce(known, []), x))) AS n_unknown FROM n""")
def claimed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of three digits or more in each reading, and how many of them the resolutions of its files do not hold."""
    digits = lambda c: F.regexp_extract_all(c, F.lit("[0-9]{3,}"), F.lit(0))
    p = table(spark, d, "page_results").filter("new_text is not null").select("staging_no", "pdf", "page", "new_text", F.explode("files").alias("source_path")).distinct()
    r = table(spark, d, "resolutions").select("source_path", F.explode_outer(F.array_distinct(digits("raw_text"))).alias("number"))
    said = p.select("staging_no", "new_text", "source_path").join(table(spark, d, "resolutions").select("source_path").distinct(), "source_path", "left_semi")
    each = said.select("staging_no", "source_path", F.explode_outer(F.array_distinct(digits("new_text"))).alias("number"))
    hit = each.join(r.filter("number is not null").distinct().withColumn("known", F.lit(1)), ["source_path", "number"], "left").groupBy("staging_no", "number").agg(F.max("known").alias("known"))
    return hit.groupBy("staging_no").agg(F.count("number").alias("n_numbers"), F.count_if(F.col("number").isNotNull() & F.col("known").isNull()).alias("n_unknown"))


@query("""WITH p AS (SELECT DISTINCT staging_no, pdf, page, new_text, staged_at FROM page_results), g AS (SELECT pdf, page, count(*) AS n, count(DISTINCT new_text) AS texts, max(staging_no) AS last FROM p GROUP BY 1, 2), s AS (SELECT pdf, count(*) AS pages FROM g GROUP BY 1)
SELECT pdf, page, last, pages - 1 AS siblings, CASE WHEN n >= 2 AND texts = 1 THEN 'apply: both new' WHEN n >= 2 AND texts = 0 THEN 'skip: keep old' WHEN n >= 2 THEN 'skip: deferred' ELSE 'skip: waiting' END AS action FROM g JOIN s USING (pdf)""")
def reading_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What is done with each page: readings that agree stand for two models that say new, several different ones for a deferral by hand, unreadable ones for keeping the old text; with the other pages of its file."""
    p = table(spark, d, "page_results").select("staging_no", "pdf", "page", "new_text", "staged_at").distinct()
    g = p.groupBy("pdf", "page").agg(F.count("*").alias("n"), F.count_distinct("new_text").alias("texts"), F.max("staging_no").alias("last"))
    s = g.groupBy("pdf").agg((F.count("*") - 1).alias("siblings"))
    verdicts = F.when((F.col("n") >= 2) & (F.col("texts") == 1), F.array(F.lit("new"), F.lit("new"))).otherwise(F.array(F.lit("old")))
    by_hand = F.when((F.col("n") >= 2) & (F.col("texts") == 0), "keep-old").when((F.col("n") >= 2) & (F.col("texts") > 1), "defer")
    return g.join(s, "pdf").select("pdf", "page", "last", "siblings", audits.decided(g, ["pdf", "page"], verdicts, by_hand).alias("action"))


@query(r"""WITH t AS (SELECT resolution_id, title FROM resolutions WHERE title IS NOT NULL), u AS (SELECT resolution_id, title, regexp_replace(title, '[ \t\n\r]+', '', 'g') AS flat FROM t), c AS (SELECT DISTINCT resolution_id FROM chunks),
o AS (SELECT u.* FROM u ANTI JOIN c USING (resolution_id)), k AS (SELECT DISTINCT flat, min(resolution_id) AS twin FROM u SEMI JOIN c USING (resolution_id) GROUP BY 1) SELECT DISTINCT o.resolution_id, twin FROM o LEFT JOIN k ON substring(o.flat, 1, greatest(1, length(o.flat) - 8)) = substring(k.flat, 1, greatest(1, length(k.flat) - 8))
  AND k.flat = (SELECT min(x.flat) FROM k x WHERE substring(o.flat, 1, greatest(1, length(o.flat) - 8)) = substring(x.flat, 1, greatest(1, length(x.flat) - 8)))""")
def orphan_twins(spark: SparkSession, d: str) -> DataFrame:
    """Documents without chunks, with the document whose title is the same up to its last eight characters, white space aside."""
    u = table(spark, d, "resolutions").filter("title is not null").select("resolution_id", F.regexp_replace("title", r"[ \t\n\r]+", "").alias("flat"))
    u = u.withColumn("stem", F.substring("flat", F.lit(1), F.greatest(F.lit(1), F.length("flat") - 8)))
    c = table(spark, d, "chunks").select("resolution_id").distinct()
    k = u.join(c, "resolution_id", "left_semi").groupBy("stem", "flat").agg(F.min("resolution_id").alias("twin")).groupBy("stem").agg(F.min_by("twin", "flat").alias("twin"))
    return u.join(c, "resolution_id", "left_anti").join(k, "stem", "left").select("resolution_id", "twin").distinct()


@query("""WITH n AS (SELECT DISTINCT q.query_id, r.resolution_id FROM queries q JOIN resolutions r ON trim(q.entity) <> '' AND contains(r.title, q.entity)), j AS (SELECT DISTINCT query_id, resolution_id FROM qrels WHERE resolution_id IS NOT NULL)
SELECT coalesce(n.query_id, j.query_id) AS query_id, count(n.resolution_id) AS named, count(j.resolution_id) AS judged, count(*) FILTER (n.resolution_id IS NOT NULL AND j.resolution_id IS NOT NULL) AS both,
CASE WHEN count(n.resolution_id) = 0 THEN 'no name' WHEN count(*) = count(*) FILTER (n.resolution_id IS NOT NULL AND j.resolution_id IS NOT NULL) THEN 'same' WHEN 2 * count(*) FILTER (n.resolution_id IS NOT NULL AND j.resolution_id IS NOT NULL) < count(n.resolution_id) THEN 'ambiguous' ELSE 'ok' END AS status FROM n FULL JOIN j ON n.query_id = j.query_id AND n.resolution_id = j.resolution_id GROUP BY 1""")
def anchor_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """The documents that name a query's entity against those judged relevant: ambiguous where less than half of the naming ones are."""
    q = table(spark, d, "queries").select("query_id", "entity")
    r = table(spark, d, "resolutions").select("res_no", "resolution_id", "title")
    n = dictionaries.mentions(r, "res_no", "title", q, "entity", flat=False, alone=False).join(q, "entity").join(r.select("res_no", "resolution_id"), "res_no").select("query_id", "resolution_id").distinct().withColumn("n", F.lit(1))
    both = n.join(metrics.judged(table(spark, d, "qrels")).withColumn("j", F.lit(1)), ["query_id", "resolution_id"], "full")
    hit = F.col("n").isNotNull() & F.col("j").isNotNull()
    g = both.groupBy("query_id").agg(F.count("n").alias("named"), F.count("j").alias("judged"), F.count_if(hit).alias("both"), F.count("*").alias("all"))
    status = F.when(F.col("named") == 0, "no name").when(F.col("all") == F.col("both"), "same").when(2 * F.col("both") < F.col("named"), "ambiguous").otherwise("ok")
    return g.select("query_id", "named", "judged", "both", status.alias("status"))


@query("""WITH v AS (SELECT DISTINCT p AS program, f AS faculty FROM (SELECT unnest(programs) AS p, faculties FROM resolutions), LATERAL (SELECT unnest(faculties) AS f)), g AS (SELECT program, faculty FROM v WHERE program IS NOT NULL)
SELECT 'faculty of the list' AS "check", count(*) AS n, count(*) FILTER (faculty IS NOT NULL AND faculty NOT IN (SELECT canonical FROM faculties)) AS bad FROM g UNION ALL SELECT 'programme of the list', count(*), count(*) FILTER (program NOT IN (SELECT canonical FROM programs)) FROM g
UNION ALL SELECT 'every programme reached', (SELECT count(*) FROM programs), (SELECT count(*) FROM programs WHERE canonical NOT IN (SELECT program FROM g)) UNION ALL SELECT 'edge with a faculty', count(*), count(*) FILTER (faculty IS NULL) FROM g""")
def graph_checks(spark: SparkSession, d: str) -> DataFrame:
    """The graph of programmes and faculties that documents are tagged with, against the reference lists."""
    g = stored(table(spark, d, "resolutions").select(F.explode("programs").alias("program"), "faculties").select("program", F.explode("faculties").alias("faculty")).filter("program is not null").distinct())
    f = table(spark, d, "faculties").select(F.col("canonical").alias("faculty")).distinct().withColumn("f", F.lit(1))
    p = table(spark, d, "programs").select(F.col("canonical").alias("program")).distinct().withColumn("p", F.lit(1))
    both = g.join(f, "faculty", "left").join(p, "program", "left")
    one = both.agg(F.count("*").alias("n"), F.count_if(F.col("faculty").isNotNull() & F.col("f").isNull()).alias("b0"), F.count_if(F.col("p").isNull()).alias("b1"), F.count_if(F.col("faculty").isNull()).alias("b2"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col("n"), F.col(b).alias("bad")) for c, b in (("faculty of the list", "b0"), ("programme of the list", "b1"), ("edge with a faculty", "b2"))])).alias("c")).select("c.*")
    reached = table(spark, d, "programs").select(F.col("canonical").alias("program")).join(g.select("program").distinct().withColumn("g", F.lit(1)), "program", "left").agg(F.lit("every programme reached").alias("check"), F.count("*").alias("n"), F.count_if(F.col("g").isNull()).alias("bad"))
    return rows.unionByName(reached)


_ANSWER = "CASE WHEN max(label) = 1 THEN 'ไม่พบข้อมูล [1]' ELSE string_agg('[' || (label + (label - 1) % 3) || ']', ' ' ORDER BY label) END"
_BLOCKS = f"""x AS (SELECT *, dense_rank() OVER (PARTITION BY combination_id, query_id ORDER BY fr) AS label FROM (SELECT *, min(rank) OVER (PARTITION BY combination_id, query_id, resolution_id) AS fr FROM r WHERE resolution_id IS NOT NULL)), b AS (SELECT DISTINCT combination_id, query_id, label::INT AS label, resolution_id FROM x WHERE label <= 3)"""


@query(rf"""WITH {_BASE}, {_BLOCKS}, a AS (SELECT combination_id, query_id, {_ANSWER} AS answer, bool_or(q.query_id IS NOT NULL) AS has_gold FROM b LEFT JOIN q USING (query_id, resolution_id) GROUP BY 1, 2),
s AS (SELECT combination_id, query_id, unnest(list_distinct(regexp_extract_all(answer, '\[(\d{{1,9}})\]', 1)))::INT AS label FROM a), f AS (SELECT s.*, b.resolution_id, q.query_id IS NOT NULL AS rel FROM s LEFT JOIN b ON s.combination_id = b.combination_id AND s.query_id = b.query_id AND s.label = b.label LEFT JOIN q ON q.query_id = s.query_id AND q.resolution_id = b.resolution_id),
p AS (SELECT combination_id, query_id, count(*) AS n_cited, count(*) FILTER (resolution_id IS NULL) AS n_phantom, count(DISTINCT resolution_id) AS docs, count(DISTINCT CASE WHEN rel THEN resolution_id END) AS hits FROM f GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS n_rel FROM q GROUP BY 1)
SELECT combination_id, query_id, n_cited, n_phantom, round(hits::DOUBLE / nullif(docs, 0), 6) AS precision, round(hits::DOUBLE / n_rel, 6) AS recall, contains(answer, 'ไม่พบข้อมูล') AS abstained, has_gold FROM a JOIN p USING (combination_id, query_id) LEFT JOIN n USING (query_id)""")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Citations of answers against the documents shown and those relevant; the answers are made from the rankings by a fixed rule, as none are stored."""
    return _answers(spark, d)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    r, q = metrics.cleaned(table(spark, d, "rankings")), metrics.judged(table(spark, d, "qrels"))
    first = r.filter("resolution_id is not null").groupBy("combination_id", "query_id", "resolution_id").agg(F.min("rank").alias("fr"))
    b = stored(first.withColumn("label", F.row_number().over(Window.partitionBy("combination_id", "query_id").orderBy("fr"))).filter("label <= 3").select("combination_id", "query_id", "label", "resolution_id"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list("label")), lambda x: F.concat(F.lit("["), (x + (x - 1) % 3).cast("string"), F.lit("]"))), " ")
    a = b.join(q.withColumn("g", F.lit(True)), ["query_id", "resolution_id"], "left").groupBy("combination_id", "query_id").agg(F.when(F.max("label") == 1, f"{audits.ABSTAIN} [1]").otherwise(said).alias("answer"), F.coalesce(F.max("g"), F.lit(False)).alias("has_gold"))
    keyed = audits.cited(a.withColumn("q", F.col("query_id")), b.withColumn("q", F.col("query_id")).select("combination_id", "q", "label", "resolution_id"), q, ["combination_id", "q"])
    return keyed.drop("q").select("combination_id", "query_id", "n_cited", "n_phantom", "precision", "recall", "abstained", "has_gold")


@query(rf"""WITH {_BASE}, {_BLOCKS}, a AS (SELECT combination_id, query_id, {_ANSWER} AS answer, bool_or(q.query_id IS NOT NULL) AS has_gold FROM b LEFT JOIN q USING (query_id, resolution_id) GROUP BY 1, 2) SELECT combination_id, count_if(has_gold AND contains(answer, 'ไม่พบข้อมูล')) AS gold_abstained, count_if(has_gold AND NOT contains(answer, 'ไม่พบข้อมูล')) AS gold_answered, count_if(NOT has_gold AND contains(answer, 'ไม่พบข้อมูล')) AS none_abstained, count_if(NOT has_gold AND NOT contains(answer, 'ไม่พบข้อมูล')) AS none_answered FROM a GROUP BY 1""")
def abstention_cells(spark: SparkSession, d: str) -> DataFrame:
    """Answers by whether a relevant document was shown and whether they abstain."""
    g, a = F.col("has_gold"), F.col("abstained")
    return _answers(spark, d).groupBy("combination_id").agg(F.count_if(g & a).alias("gold_abstained"), F.count_if(g & ~a).alias("gold_answered"), F.count_if(~g & a).alias("none_abstained"), F.count_if(~g & ~a).alias("none_answered"))


@query(f"""WITH {_BASE}, u AS (SELECT DISTINCT combination_id, query_id, resolution_id FROM r WHERE rank <= 10 AND resolution_id IS NOT NULL), l AS (SELECT combination_id, count(*) AS n, count(q.query_id) AS judged FROM u LEFT JOIN q USING (query_id, resolution_id) GROUP BY 1), t AS (SELECT sum(judged)::DOUBLE / sum(n) AS rate FROM l)
SELECT combination_id, n - judged AS pool, round((n - judged) * rate, 4) AS estimate FROM l, t""")
def residual_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Unjudged documents in each combination's first ten, times the share of judged ones over all combinations."""
    u = metrics.cleaned(table(spark, d, "rankings")).filter("rank <= 10 and resolution_id is not null").select("combination_id", "query_id", "resolution_id").distinct()
    l = stored(u.join(metrics.judged(table(spark, d, "qrels")).withColumn("j", F.lit(1)), ["query_id", "resolution_id"], "left").groupBy("combination_id").agg(F.count("*").alias("n"), F.count("j").alias("judged")))  # noqa: E741
    rate = l.agg((F.sum("judged") / F.sum("n")).alias("rate"))  # one row
    return l.join(F.broadcast(rate)).select("combination_id", (F.col("n") - F.col("judged")).alias("pool"), F.round((F.col("n") - F.col("judged")) * F.col("rate"), 4).alias("estimate"))


@query(rf"""WITH {_BASE}, u AS (SELECT DISTINCT r.query_id, r.resolution_id, qq.entity_type, qq.entity FROM r JOIN q USING (query_id, resolution_id) JOIN queries qq USING (query_id) WHERE rank <= 10), t AS (SELECT resolution_id, min(raw_text) AS raw_text FROM resolutions GROUP BY 1)
SELECT entity_type, count(*) AS n, count(*) FILTER (contains(raw_text, entity)) AS present, count(*) FILTER (NOT contains(raw_text, entity)) AS absent, count(*) FILTER (raw_text IS NULL OR entity IS NULL) AS unresolved FROM u LEFT JOIN t USING (resolution_id) GROUP BY 1""")
def presence_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Relevant documents found, by whether their text holds the query's entity; what can't be told is kept apart."""
    u = metrics.cleaned(table(spark, d, "rankings")).filter("rank <= 10").join(metrics.judged(table(spark, d, "qrels")), ["query_id", "resolution_id"]).select("query_id", "resolution_id").distinct().join(table(spark, d, "queries").select("query_id", "entity_type", "entity"), "query_id")
    t = table(spark, d, "resolutions").groupBy("resolution_id").agg(F.min("raw_text").alias("raw_text"))
    has = F.contains("raw_text", F.col("entity"))
    return u.join(t, "resolution_id", "left").groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(has).alias("present"), F.count_if(~has).alias("absent"), F.count_if(has.isNull()).alias("unresolved"))


@query(f"""WITH {_BASE}, p AS (SELECT unnest([5, 10, 20]) AS depth) SELECT combination_id, depth::INT AS depth, count(*) AS n_found, min(rank) AS best, round(avg(rank), 5) AS mean_rank FROM h JOIN p ON h.rank <= depth GROUP BY 1, 2""")
def pool_depths(spark: SparkSession, d: str) -> DataFrame:
    """Relevant documents within pools of several depths, by their best chunk."""
    h = metrics.first_hits(metrics.cleaned(table(spark, d, "rankings")), table(spark, d, "qrels"))
    each = h.select("combination_id", "rank", F.explode(F.array(*map(F.lit, (5, 10, 20)))).alias("depth")).filter(F.col("rank") <= F.col("depth"))
    return each.groupBy("combination_id", "depth").agg(F.count("rank").alias("n_found"), F.min("rank").alias("best"), F.round(F.avg("rank"), 5).alias("mean_rank"))


@query(f"""WITH {_PER}, ff AS (SELECT query_id, {_FAMILY} AS family, avg(recall_10) AS v FROM m GROUP BY 1, 2) SELECT a.family AS a, b.family AS b, count(*) AS n, round(avg((round(a.v - b.v, 9) = 0)::INT), 6) AS ties, round(avg(a.v - b.v), 6) AS mean_diff FROM ff a JOIN ff b ON a.query_id = b.query_id AND a.family < b.family GROUP BY 1, 2""")
def family_ties(spark: SparkSession, d: str) -> DataFrame:
    """Families of combinations against each other, query by query: the share of ties and the mean difference."""
    f = stored(_scores(spark, d).groupBy("query_id", F.split("combination_id", "-")[0].alias("family")).agg(F.avg("recall_10").alias("v")))
    a, b = f.alias("a"), f.alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.family") < F.col("b.family")))
    diff = F.col("a.v") - F.col("b.v")
    return both.groupBy(F.col("a.family").alias("a"), F.col("b.family").alias("b")).agg(F.count("*").alias("n"), F.round(F.avg((F.round(diff, 9) == 0).cast("int")), 6).alias("ties"), F.round(F.avg(diff), 6).alias("mean_diff"))


@query(f"""WITH {_PER}, ff AS (SELECT query_id, {_FAMILY} AS family, combination_id, recall_10 FROM m), df AS (SELECT a.family || ':' || a.combination_id || ' vs ' || b.combination_id AS combination_id, a.query_id, round(a.recall_10 - b.recall_10, 6) AS diff FROM ff a JOIN ff b ON a.query_id = b.query_id AND a.family = b.family AND a.combination_id < b.combination_id),
{_BOOT[_BOOT.index(', l AS') + 2:]}, st AS (SELECT *, split_part(combination_id, ':', 1) AS family FROM bo), sp AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, combination_id) + 1) * p AS step FROM st)
SELECT family, combination_id AS pair, mean, p, round(least(1.0, max(step) OVER (PARTITION BY family ORDER BY p, combination_id ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM sp""")
def family_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of combinations of each family, tested by bootstrap and corrected within the family."""
    levels = F.broadcast(_family_levels(spark, d))  # at most as many p as half of the resamples, of each family
    rows = stats.pairs(_family_boot(spark, d), _family_blocks(spark, d), "part", "combination_id", ["p", "mean"])
    return rows.withColumn("family", _own()).join(levels, ["family", "p"]).select("family", _pair(), "mean", "p", "adjusted")


def _own() -> Column:
    return F.substring_index("part", ":", 1)


def _pair() -> Column:
    return F.concat("part", F.lit(":"), "a", F.lit(" vs "), "b").alias("pair")


def _family_blocks(spark: SparkSession, d: str, metric: str = "recall_10") -> DataFrame:
    scores = lambda: _scores(spark, d).select(F.split("combination_id", "-")[0].alias("part"), "combination_id", "query_id", metric)
    return built(spark, f"family blocks {metric}", d, lambda: stats.blocks(scores(), "part", "combination_id", "query_id", metric))


def _family_boot(spark: SparkSession, d: str, metric: str = "recall_10") -> DataFrame:
    """Mean and p of all pairs of each family, in arrays."""
    return built(spark, f"families {metric}", d, lambda: stats.paired(_family_blocks(spark, d, metric), "part", "combination_id", ["mean", "p"], partial(stats.tested, n_boot=N_BOOT)))


def _family_counts(spark: SparkSession, d: str, metric: str = "recall_10") -> DataFrame:
    """family, p, n, least: how many pairs have each p, and the least mean of them."""
    rows = _family_boot(spark, d, metric).select("part", F.posexplode("p").alias("pos", "p"), "mean").select(_own().alias("family"), "p", F.col("mean")[F.col("pos")].alias("mean"))
    return built(spark, f"family counts {metric}", d, lambda: rows.groupBy("family", "p").agg(F.count("*").alias("n"), F.min("mean").alias("least")))


def _family_levels(spark: SparkSession, d: str, metric: str = "recall_10") -> DataFrame:
    return stats.holm_levels(_family_counts(spark, d, metric), "family", "p", "n")


@query()
def report_changes(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons whose verdict or difference is another by nDCG than by recall."""
    keys = ["part", "combination_id", "block", "skip"]
    own = lambda m, i: _family_boot(spark, d, m).select(*keys, F.col("mean").alias(f"d{i}"), F.col("p").alias(f"p{i}"))
    level = lambda m, i: F.broadcast(_family_levels(spark, d, m).select("family", F.col("p").alias(f"p{i}"), F.col("reject").alias(f"s{i}")))

    def changed(rows: DataFrame) -> DataFrame:
        known = rows.withColumn("family", _own()).join(level("recall_10", 0), ["family", "p0"]).join(level("ndcg_10", 1), ["family", "p1"])
        return known.withColumn("change", audits.change(*map(F.col, ("d0", "s0", "d1", "s1")))).filter("change is not null")

    both = own("recall_10", 0).join(own("ndcg_10", 1), keys)
    rows = stats.pairs(both, _family_blocks(spark, d), "part", "combination_id", ["p0", "d0", "p1", "d1"], changed)
    return rows.select(_pair(), "change", F.round("d0", 6).alias("old"), F.round("d1", 6).alias("new"))


@query()
def decision_rule(spark: SparkSession, d: str) -> DataFrame:
    """Stop, narrow or go on with each family, by its comparisons."""
    b = _family_counts(spark, d).join(F.broadcast(_family_levels(spark, d)), ["family", "p"])
    cells = b.groupBy("family").agg(F.sum("n").cast("int").alias("n"), F.collect_list(F.struct(F.col("least").alias("diff"), F.col("reject").alias("significant"))).alias("c"))  # a cell for each p, with its least difference
    return cells.select("family", "n", audits.decision(F.col("c"), 0.05).alias("verdict"))


@query()
def simulated_power(spark: SparkSession, d: str) -> DataFrame:
    """How often differences of 0.05 and 0.1 would be found, by trials on the centred differences of each combination."""
    return stats.power(_diffs(spark, d), "combination_id", "query_id", "diff", [0.05, 0.1], 60, 400)


@query(f"WITH {_DIFFS}, v AS (SELECT combination_id, stddev_samp(diff) AS sd, avg(diff) AS mean, count(*) AS n FROM df GROUP BY 1), z AS (SELECT *, sqrt(-2 * ln(0.025 / (SELECT count(*) FROM v))) AS t FROM v), k AS (SELECT *, (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) + 0.8416212) * sd AS one FROM z) SELECT combination_id, ceil(one * one / 0.0025)::BIGINT AS n_needed, CASE WHEN abs(mean) >= one / sqrt(n) THEN 'detectable' ELSE 'below the limit' END AS verdict FROM k")
def sample_needed(spark: SparkSession, d: str) -> DataFrame:
    """Queries needed to find a difference of 0.05, and whether each measured one is within reach of those there are."""
    v = stored(_diffs(spark, d).groupBy("combination_id").agg(F.stddev_samp("diff").alias("sd"), F.avg("diff").alias("mean"), F.count("*").alias("n")))
    tests = max(1, v.count())
    limit = stats.mde(F.col("sd"), F.col("n"), tests=tests)
    return v.select("combination_id", stats.needed(F.col("sd"), 0.05, tests=tests).cast("bigint").alias("n_needed"), F.when(F.abs("mean") >= limit, "detectable").otherwise("below the limit").alias("verdict"))


_TEMPLATES = ("{e} ถูกพิจารณาเมื่อใด", "มติเกี่ยวกับ {e}", "ขอรายละเอียดของ {e}")
_TEMPLATE_SQL = "CASE (('0x' || substring(md5('42:' || kind || ':' || name), 1, 8))::BIGINT % 3) " + " ".join(f"WHEN {i} THEN replace('{t}', '{{e}}', name)" for i, t in enumerate(_TEMPLATES)) + " END"


@query(f"""WITH n AS (SELECT 'program' AS kind, canonical AS name FROM programs UNION ALL SELECT 'faculty', canonical FROM faculties) SELECT kind, name, {_TEMPLATE_SQL} AS query FROM n WHERE name NOT IN (SELECT entity FROM queries WHERE entity IS NOT NULL)""")
def training_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries for training over names that no test query asks for, each in the wording its name's hash picks."""
    p, f = table(spark, d, "programs").select(F.lit("program").alias("kind"), F.col("canonical").alias("name")), table(spark, d, "faculties").select(F.lit("faculty").alias("kind"), F.col("canonical").alias("name"))
    free = p.union(f).join(table(spark, d, "queries").filter("entity is not null").select(F.col("entity").alias("name")).distinct(), "name", "left_anti")
    pick = stats.hashed(F.concat(F.lit("42:"), "kind", F.lit(":"), "name"), F.lit(len(_TEMPLATES)))
    text = F.coalesce(*[F.when(pick == i, F.replace(F.lit(t), F.lit("{e}"), F.col("name"))) for i, t in enumerate(_TEMPLATES)])
    return free.select("kind", "name", text.alias("query"))


@query("""WITH p AS (SELECT canonical FROM programs), h AS (SELECT canonical, resolution_id, string_split(resolution_id, ' — ')[1] AS event FROM (SELECT DISTINCT resolution_id FROM resolutions) r JOIN p ON contains(r.resolution_id, p.canonical))
SELECT canonical, count(DISTINCT event) AS n_events, count(*) AS n_docs FROM h GROUP BY 1 HAVING count(DISTINCT event) >= 2""")
def program_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Programmes whose name stands in the ids of at least two events."""
    ids = table(spark, d, "resolutions").select("resolution_id").distinct().withColumn("t", F.col("resolution_id"))
    h = dictionaries.mentions(ids, "resolution_id", "t", table(spark, d, "programs").select("canonical"), "canonical", flat=False, alone=False)
    return h.groupBy("canonical").agg(F.count_distinct(tx.event_key(F.col("resolution_id"))).alias("n_events"), F.count("*").alias("n_docs")).filter("n_events >= 2")


@query(f"""WITH p AS ({corpus_tables._PEOPLE('doc_id', 'text', 'documents')}), n AS (SELECT DISTINCT id, given || ' ' || surname AS name FROM p),
s AS (SELECT id, name, string_split(text, name) AS l FROM n JOIN documents ON id = doc_id), k AS (SELECT id, name, list_bool_or(list_transform(range(2, len(l) + 1), lambda i: NOT contains(substring(list_reduce(l[i:], lambda a, b: a || name || b), 1, 80), 'เลขานุการ'))) AS acts FROM s WHERE len(l) > 1)
SELECT name, count(*) AS n_docs, count_if(acts) AS n_acting FROM k GROUP BY 1""")
def person_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name each person with a title, and those where at least one mention is not followed by the secretary's mark within 80 characters."""
    p = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array_distinct(F.transform(dictionaries.people(F.col("text")), lambda x: F.concat_ws(" ", x["given"], x["surname"])))).alias("name"))
    parts = F.split("text", F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")))
    acts = F.exists(F.sequence(F.lit(2), F.size("l")), lambda i: ~F.contains(F.substring(F.array_join(F.transform(F.slice(F.col("l"), i, F.size("l")), lambda x, j: F.when(j == 0, x).otherwise(F.concat(F.col("name"), x))), ""), 1, 80), F.lit("เลขานุการ")))
    k = p.withColumn("l", parts).filter(F.size("l") > 1).select("name", acts.alias("acts"))
    return k.groupBy("name").agg(F.count("*").alias("n_docs"), F.count_if("acts").alias("n_acting"))


@query("""SELECT f AS faculty, count(DISTINCT resolution_id) AS n_docs FROM (SELECT resolution_id, unnest(faculties) AS f FROM resolutions WHERE regexp_matches(title, 'ผู้สอน[ \t]*พิเศษ')) WHERE f IS NOT NULL GROUP BY 1""")
def adjunct_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Filings about adjunct teachers, by the faculty they are tagged with."""
    r = table(spark, d, "resolutions").filter(entities.adjunct_title(F.col("title"), r"ผู้สอน[ \t]*พิเศษ", None))
    return r.select("resolution_id", F.explode("faculties").alias("faculty")).filter("faculty is not null").groupBy("faculty").agg(F.count_distinct("resolution_id").alias("n_docs"))


@query(f"""WITH t AS (SELECT res_no, unnest({_CODES.format('raw_text')}) AS code FROM resolutions WHERE raw_text IS NOT NULL), x AS (SELECT regexp_extract_all(raw_text, '{corpus_tables._ROWS}', 1) AS c, regexp_extract_all(raw_text, '{corpus_tables._ROWS}', 2) AS t FROM resolutions), cn AS (SELECT trim(unnest(t)) AS name, unnest(c) AS code FROM x), cu AS (SELECT name, min(code) AS code FROM cn WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT code) = 1),
n AS (SELECT DISTINCT res_no, code FROM resolutions JOIN cu ON {_PHRASE.format('raw_text', 'name')}) SELECT coalesce(t.code, n.code) AS code, count(t.res_no) AS n_coded, count(n.res_no) AS n_naming, count(*) FILTER (t.res_no IS NOT NULL AND n.res_no IS NOT NULL) AS n_both,
CASE WHEN count(n.res_no) = 0 THEN 'no_name_evidence' WHEN 2 * count(*) FILTER (t.res_no IS NOT NULL AND n.res_no IS NOT NULL) < count(n.res_no) THEN 'ambiguous' ELSE 'ok' END AS status FROM t FULL JOIN n ON t.res_no = n.res_no AND t.code = n.code GROUP BY 1""")
def course_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Courses by the documents that hold their code and those that hold their unique name."""
    from kosha.plans.entity_queries import courses_by_name

    t = table(spark, d, "resolutions").select("res_no", F.explode(entities.course_codes(F.col("raw_text"))).alias("code")).withColumn("t", F.lit(1))
    both = t.join(courses_by_name(spark, d).withColumn("n", F.lit(1)), ["res_no", "code"], "full")
    hit = F.col("t").isNotNull() & F.col("n").isNotNull()
    g = both.groupBy("code").agg(F.count("t").alias("n_coded"), F.count("n").alias("n_naming"), F.count_if(hit).alias("n_both"))
    return g.withColumn("status", F.when(F.col("n_naming") == 0, "no_name_evidence").when(2 * F.col("n_both") < F.col("n_naming"), "ambiguous").otherwise("ok"))


@query(r"""WITH e AS (SELECT year, session, string_split(resolution_id, ' — ')[1] AS event, resolution_id, source_path, regexp_matches(source_path, '__[0-9]+\.md$') AS piece FROM resolutions WHERE year IS NOT NULL AND session IS NOT NULL)
SELECT year, session, event, count(DISTINCT resolution_id) AS n_members, arg_min(resolution_id, (piece::INT, source_path, resolution_id)) AS representative FROM e GROUP BY 1, 2, 3""")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    """The items of each meeting, with the whole file before its parts as the one that stands for it."""
    r = table(spark, d, "resolutions").filter("year is not null and session is not null")
    piece = F.col("source_path").rlike(r"__[0-9]+\.md$").cast("int")
    return r.groupBy("year", "session", tx.event_key(F.col("resolution_id")).alias("event")).agg(F.count_distinct("resolution_id").alias("n_members"), F.min_by("resolution_id", F.struct(piece, "source_path", "resolution_id")).alias("representative"))


@query("""WITH m AS (SELECT resolution_id AS old, 'moved/' || resolution_id AS new FROM resolutions WHERE res_no % 2 = 0 AND resolution_id IN (SELECT resolution_id FROM chunks)), c AS (SELECT DISTINCT chunk_id, resolution_id, chunk_index FROM chunks)
SELECT CASE WHEN new IS NULL THEN chunk_id ELSE new || ':' || chunk_index END AS chunk_id, coalesce(new, resolution_id) AS resolution_id, chunk_index FROM c LEFT JOIN m ON old = resolution_id""")
def relabelled_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after half of the documents got new ids."""
    c = table(spark, d, "chunks").select("chunk_id", "resolution_id", "chunk_index").distinct()
    m = table(spark, d, "resolutions").filter("res_no % 2 = 0").select(F.col("resolution_id").alias("old"), F.concat(F.lit("moved/"), "resolution_id").alias("new")).join(c.select(F.col("resolution_id").alias("old")).distinct(), "old", "left_semi")
    return audits.relabelled(c, m)


@query(f"""WITH {_BASE}, x AS (SELECT combination_id, query_id, md5(string_agg(coalesce(chunk_id, ''), ',' ORDER BY rank)) AS input, md5(string_agg(coalesce(resolution_id, ''), ',' ORDER BY rank)) AS output FROM r GROUP BY 1, 2)
SELECT a.combination_id AS a, b.combination_id AS b, count(*) AS n_same_input, count_if(a.output = b.output) AS n_same_output FROM x a JOIN x b ON a.query_id = b.query_id AND a.input = b.input AND a.combination_id < b.combination_id GROUP BY 1, 2""")
def unchanged_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Queries for which two combinations got the same chunks, and how often their documents agree too."""
    r = metrics.cleaned(table(spark, d, "rankings"))
    joined = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.col(c), F.lit("")).alias("v")))), lambda z: z["v"]), ","))
    x = stored(r.groupBy("combination_id", "query_id").agg(joined("chunk_id").alias("input"), joined("resolution_id").alias("output")))
    a, b = x.alias("a"), x.alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.input") == F.col("b.input")) & (F.col("a.combination_id") < F.col("b.combination_id")))
    return both.groupBy(F.col("a.combination_id").alias("a"), F.col("b.combination_id").alias("b")).agg(F.count("*").alias("n_same_input"), F.count_if(F.col("a.output") == F.col("b.output")).alias("n_same_output"))


@query(f"""WITH p AS ({corpus_tables._PEOPLE('doc_id', 'text', 'documents')}), n AS (SELECT DISTINCT id, given || ' ' || surname AS name FROM p) SELECT name, list_sort(list(id)) AS docs FROM n GROUP BY 1""")
def person_slice(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each person by the whole name; a name inside a longer one doesn't count."""
    p = table(spark, d, "documents").select("doc_id", F.explode(dictionaries.people(F.col("text"))).alias("p")).select("doc_id", F.concat_ws(" ", "p.given", "p.surname").alias("name")).distinct()
    return p.groupBy("name").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))


@query("""WITH s AS (SELECT r.res_no, md5(string_agg(q.query_id::VARCHAR || ':' || q.resolution_id, ',' ORDER BY q.query_id, q.resolution_id)) AS fingerprint, count(*) AS n FROM resolutions r JOIN (SELECT DISTINCT query_id, resolution_id FROM qrels WHERE resolution_id IS NOT NULL) q USING (resolution_id) GROUP BY 1) SELECT fingerprint, n, count(*) AS n_docs FROM s GROUP BY 1, 2""")
def input_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a fingerprint of the judgements made on them, by which work done before is found again."""
    q = metrics.judged(table(spark, d, "qrels"))
    s = table(spark, d, "resolutions").select("res_no", "resolution_id").join(q, "resolution_id").groupBy("res_no").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "resolution_id"))), lambda z: F.concat(z["query_id"].cast("string"), F.lit(":"), z["resolution_id"])), ",")).alias("fingerprint"), F.count("*").alias("n"))
    return s.groupBy("fingerprint", "n").agg(F.count("*").alias("n_docs"))


@query(f"WITH t AS (SELECT res_no, {_SUBJECT} AS s, title FROM resolutions WHERE title IS NOT NULL) SELECT s = trim(title) AS same, count(*) AS n, round(avg(length(s)), 6) AS mean FROM t GROUP BY 1")
def subject_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are the subject line itself."""
    t = table(spark, d, "resolutions").filter("title is not null").select("title", tx.subject_line(F.col("raw_text")).alias("s"))
    return t.groupBy((F.col("s") == F.trim("title")).alias("same")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("s")), 6).alias("mean"))
