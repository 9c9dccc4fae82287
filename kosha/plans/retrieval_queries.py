"""Rankings by words and vectors, their fusion, and entity filters, over the whole index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kosha.functions import text as tx
from kosha.operators import dense, dictionaries, entities, fusion, lexical
from kosha.plans.registry import query
from kosha.session import built, stored, table

TOP, ARM = 10, 50


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The index without repeated rows; of rows that differ in the rest the least text, index and page."""
    return table(spark, d, "chunks").groupBy("chunk_id", "resolution_id").agg(F.min("text").alias("text"), F.min("chunk_index").alias("chunk_index"), F.min("page").alias("page"))


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same, stored once for all queries of an application, as the index is built once and queried often."""
    return built(spark, "chunks", d, lambda: chunks(spark, d))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """Weighted postings in ranges of term and chunk, so that a scan for a query's terms passes over the rest and a term that half of the chunks hold is several parts."""
    return built(spark, "postings", d, lambda: lexical.weighted_postings(index_chunks(spark, d), "chunk_id", "text").repartitionByRange("term", "chunk_id").sortWithinPartitions("term"))


def _bm25(spark: SparkSession, d: str, k: int, docs: DataFrame | None = None) -> DataFrame:
    """The k best chunks of each query, with those of score 0 where fewer share a word; a filtered index has its own statistics."""
    queries = table(spark, d, "queries")
    if docs is None:
        return lexical.bm25(queries, "query_id", "query", _postings(spark, d), "chunk_id", k, index_chunks(spark, d))
    docs = stored(docs)
    return lexical.bm25(queries, "query_id", "query", stored(lexical.weighted_postings(docs, "chunk_id", "text")), "chunk_id", k, docs)


def _dense_arm(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Queries against chunks by the cosine of hashed bags of words."""
    c = built(spark, "vectors", d, lambda: dense.hash_vectors(index_chunks(spark, d), "chunk_id", "text", 64))
    q = dense.hash_vectors(table(spark, d, "queries").select(F.concat(F.lit("q:"), F.col("query_id").cast("string")).alias("chunk_id"), F.col("query").alias("text")), "chunk_id", "text", 64)
    got = dense.cosine_top_k(q, c, "chunk_id", "v", k)
    return got.select(F.substring("query_key", 3, 20).cast("int").alias("query_id"), "chunk_id", "score", "rank")


_C = "c AS (SELECT chunk_id, resolution_id, min(text) AS text, min(chunk_index) AS chunk_index, min(page) AS page FROM chunks GROUP BY ALL)"
_TOK = r"coalesce(list_filter(regexp_split_to_array(lower(text), '[ \n\t]+'), lambda t: t <> ''), [])"


def _bm25_sql(src: str) -> str:
    return f"""
t AS (SELECT chunk_id, {_TOK} AS ts FROM {src}), n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
p AS (SELECT chunk_id, term, len AS dl, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM t) GROUP BY ALL),
r AS (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p GROUP BY term),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
w AS (SELECT term, chunk_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM n))) AS weight FROM p JOIN i USING (term)),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK}) AS term FROM (SELECT query_id, query AS text FROM queries)) GROUP BY ALL),
bp AS (SELECT query_id, chunk_id, round(sum(qtf * weight), 6) AS score FROM qt JOIN w USING (term) GROUP BY ALL),
bs AS (SELECT q.query_id, t.chunk_id, coalesce(score, 0) AS score FROM queries q CROSS JOIN t LEFT JOIN bp ON bp.query_id = q.query_id AND bp.chunk_id = t.chunk_id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs)"""


def _vec_sql(src: str, key: str) -> str:
    return f"""SELECT {key}, list_transform(range(0, 64), lambda x: coalesce(len(list_filter(bs, lambda y: y = x)), 0)::DOUBLE) AS v FROM (SELECT {key}, list_transform({_TOK}, lambda t: ((((('0x' || substring(md5(t), 1, 8))::BIGINT % 64) * 0 + ('0x' || substring(md5(t), 9, 8))::BIGINT) % 64 * 0 + ('0x' || substring(md5(t), 17, 8))::BIGINT) % 64 * 0 + ('0x' || substring(md5(t), 25, 8))::BIGINT) % 64) AS bs FROM {src})"""


_DENSE = f"""
cv AS ({_vec_sql('c', 'chunk_id')}), qv AS ({_vec_sql('(SELECT query_id, query AS text FROM queries)', 'query_id')}),
ds AS (SELECT query_id, chunk_id, round(CASE WHEN list_dot_product(qv.v, qv.v) * list_dot_product(cv.v, cv.v) > 0 THEN list_cosine_similarity(qv.v, cv.v) ELSE 0 END, 6) AS score FROM qv, cv),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)"""


@query(f"WITH {_C}, {_bm25_sql('c')} SELECT query_id, chunk_id, score, rank FROM b WHERE rank <= {TOP}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, TOP)


@query(f"WITH {_C}, f AS (SELECT * FROM c WHERE resolution_id LIKE '2567/%'), {_bm25_sql('f')} SELECT query_id, chunk_id, score, rank FROM b WHERE rank <= {TOP}")
def bm25_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before the corpus statistics, which belong to the filtered index."""
    return _bm25(spark, d, TOP, chunks(spark, d).filter(F.startswith("resolution_id", F.lit("2567/"))))


@query(f"WITH {_C}, {_bm25_sql('c')} SELECT term, df, round(idf, 6) AS idf FROM i")
def term_stats_idf(spark: SparkSession, d: str) -> DataFrame:
    c = stored(chunks(spark, d))
    return lexical.term_stats(lexical.postings(c, "chunk_id", "text"), c.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_C}, {_bm25_sql('c')} SELECT chunk_id, count(*) AS n_terms, round(sqrt(sum(weight * weight)), 5) AS norm FROM w GROUP BY 1")
def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    w = lexical.weighted_postings(stored(chunks(spark, d)), "chunk_id", "text")
    return w.groupBy("chunk_id").agg(F.count("*").alias("n_terms"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 5).alias("norm"))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_key, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP}""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    e = table(spark, d, "embeddings")
    return dense.cosine_top_k(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", TOP)


@query(f"WITH {_C}, {_DENSE} SELECT query_id, chunk_id, score, rank FROM d WHERE rank <= {TOP}")
def hash_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense_arm(spark, d, TOP)


_JOIN = """
j AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, x.score AS ds, x.rank AS dr, y.score AS ls, y.rank AS lr
  FROM (SELECT * FROM d WHERE rank <= {0}) x FULL JOIN (SELECT * FROM b WHERE rank <= {0}) y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id)"""
_RANKED = "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr ASC NULLS LAST, lr ASC NULLS LAST, chunk_id) AS rank FROM s) WHERE rank <= {0}"
_RRF = "s AS (SELECT *, round(coalesce(0.5 / (60 + dr), 0) + coalesce(0.5 / (60 + lr), 0), 9) AS score FROM j)"


def _arms(spark: SparkSession, d: str, depth: int) -> DataFrame:
    return fusion.both(_dense_arm(spark, d, ARM), _bm25(spark, d, ARM), "query_id", "chunk_id", depth)


@query(f"WITH {_C}, {_bm25_sql('c')}, {_DENSE}, {_JOIN.format(ARM)}, {_RRF} {_RANKED.format(TOP)}")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.rrf(_arms(spark, d, ARM)), "query_id", "chunk_id", TOP).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_C}, {_bm25_sql('c')}, {_DENSE}, {_JOIN.format(5)}, {_RRF} {_RANKED.format(TOP)}")
def hybrid_fetch_depth(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.rrf(_arms(spark, d, 5)), "query_id", "chunk_id", TOP).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_C}, {_bm25_sql('c')}, {_DENSE}, {_JOIN.format(ARM)}, m AS (SELECT *, max(ds) OVER (PARTITION BY query_id) AS dm, max(ls) OVER (PARTITION BY query_id) AS lm FROM j),
s AS (SELECT *, round(0.5 * coalesce(CASE WHEN dm > 0 THEN ds / dm ELSE 0 END, 0) + 0.5 * coalesce(CASE WHEN lm > 0 THEN ls / lm ELSE 0 END, 0), 6) AS score FROM m) {_RANKED.format(TOP)}""")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.weighted(_arms(spark, d, ARM), "query_id"), "query_id", "chunk_id", TOP).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_C}, {_bm25_sql('c')}, {_DENSE}, {_JOIN.format(ARM)}, a AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha),
s AS (SELECT *, round(coalesce(alpha / (60 + dr), 0) + coalesce((1 - alpha) / (60 + lr), 0), 9) AS score FROM j, a)
SELECT alpha, query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, dr ASC NULLS LAST, lr ASC NULLS LAST, chunk_id) AS rank FROM s) WHERE rank <= {TOP}""")
def rrf_alpha_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = _arms(spark, d, ARM).withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    both = fusion.rrf(grid, F.col("alpha")).withColumn("q", F.struct("alpha", "query_id"))
    return fusion.ranked(both, "q", "chunk_id", TOP).select("alpha", "query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_C}, {_bm25_sql('c')}, {_DENSE}, h AS (SELECT 0 AS arm, query_id, chunk_id, rank FROM d WHERE rank <= {ARM} UNION ALL SELECT 1, query_id, chunk_id, rank FROM b WHERE rank <= {ARM}),
s AS (SELECT query_id, resolution_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(arm := arm, rank := rank)) AS seen, min(rank) AS best_rank FROM h JOIN c USING (chunk_id) GROUP BY ALL)
SELECT query_id, resolution_id, score, best_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, resolution_id) AS rank FROM s) WHERE rank <= {TOP}""")
def rrf_merge_docs(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense_arm(spark, d, ARM).withColumn("arm", F.lit(0)).union(_bm25(spark, d, ARM).select("query_id", "chunk_id", "score", "rank").withColumn("arm", F.lit(1)))
    docs = hits.join(index_chunks(spark, d).select("chunk_id", "resolution_id"), "chunk_id")
    return fusion.merge_documents(docs, "query_id", "resolution_id", "arm", TOP).select("query_id", "resolution_id", "score", F.col("best_rank").cast("bigint").alias("best_rank"), "rank")


@query(f"""WITH v AS (SELECT vec_id // 8 AS doc, embedding::DOUBLE[] AS e, vec_id FROM embeddings), p AS (SELECT q.doc AS query_key, x.doc, q.vec_id, max(list_dot_product(q.e, x.e)) AS m FROM v q, v x WHERE q.doc % 20 = 0 GROUP BY ALL), s AS (SELECT query_key, doc, round(sum(m), 6) AS score FROM p GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= {TOP}""")
def maxsim(spark: SparkSession, d: str) -> DataFrame:
    """Documents of eight vectors; those whose number is divisible by 20 against all."""
    docs = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e")).select("doc", F.col("e.embedding").alias("vectors"))
    return dense.maxsim_top_k(docs.filter("doc % 20 = 0"), docs, "doc", "vectors", TOP)


@query(f"""WITH {_C}, {_bm25_sql('c')}, o AS (SELECT query_id, chunk_id, b.score AS first, b.rank, len(list_intersect({_TOK.replace('text', 'c.text')}, {_TOK.replace('text', 'q.query')})) AS shared FROM b JOIN c USING (chunk_id) JOIN queries q USING (query_id) WHERE b.rank <= {ARM})
SELECT query_id, chunk_id, shared, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, rank) AS new_rank FROM o) WHERE new_rank <= {TOP}""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A wider pool, ordered by the number of distinct words shared with the query."""
    from pyspark.sql.window import Window

    pool = _bm25(spark, d, ARM).join(index_chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(table(spark, d, "queries").select("query_id", "query"), "query_id")
    shared = pool.withColumn("shared", F.size(F.array_intersect(lexical.tokens(F.col("text")), lexical.tokens(F.col("query")))).cast("bigint"))
    ranked = shared.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "rank")))
    return ranked.filter(F.col("new_rank") <= TOP).select("query_id", "chunk_id", "shared", "new_rank")


_PHRASE = r"regexp_matches(regexp_replace({0}, '[ \t\n\r]+', ' ', 'g'), '(?i)(^|[^A-Za-z0-9])' || regexp_escape(trim(regexp_replace({1}, '[ \t\n\r]+', ' ', 'g'), ' ')) || '($|[^A-Za-z0-9])')"


@query(f"SELECT query_id, res_no FROM resolutions JOIN queries ON entity IS NOT NULL AND trim(entity) <> '' AND {_PHRASE.format('title', 'entity')}")
def phrase_containment(spark: SparkSession, d: str) -> DataFrame:
    """Titles that name a query's entity as a standalone phrase, by one automaton over all entities."""
    q = table(spark, d, "queries").select("query_id", "entity")
    return dictionaries.mentions(table(spark, d, "resolutions"), "res_no", "title", q, "entity").join(q, "entity").select("query_id", "res_no")


@query(f"""WITH {_C}, {_bm25_sql('c')}, h AS (SELECT query_id, chunk_id, score, rank, coalesce(q.entity IS NOT NULL AND trim(q.entity) <> '' AND {_PHRASE.format('c.text', 'q.entity')}, false) AS hit FROM b JOIN c USING (chunk_id) JOIN queries q USING (query_id) WHERE rank <= {ARM})
SELECT query_id, chunk_id, score, rank, hit, row_number() OVER (PARTITION BY query_id ORDER BY (rank <= 20) DESC, CASE WHEN rank <= 20 THEN NOT hit ELSE false END, rank) AS new_rank FROM h""")
def lexical_containment(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d, ARM).join(index_chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(table(spark, d, "queries").select("query_id", "entity"), "query_id")
    return fusion.partition_first(hits.withColumn("hit", tx.contains_phrase(F.col("text"), F.col("entity"))), "query_id", F.col("hit"), 20).select("query_id", "chunk_id", "score", "rank", "hit", "new_rank")


@query(f"""WITH {_C}, f AS (SELECT resolution_id FROM resolutions WHERE list_has_any(faculties, ['คณะเกษตรแม่นยำ', 'คณะวิทยาการสมุทร']) AND len(programs) > 0)
SELECT chunk_id, resolution_id, page, 1.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY resolution_id ORDER BY chunk_index, chunk_id) AS r FROM c SEMI JOIN f USING (resolution_id)) WHERE r = 1""")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every document tagged with one of the faculties and any programme, by its first chunk; no cut at k."""
    tagged = table(spark, d, "resolutions").filter(entities.entity_filter({"faculties": ["คณะเกษตรแม่นยำ", "คณะวิทยาการสมุทร"]}) & (F.size("programs") > 0)).select("resolution_id")
    own = chunks(spark, d).join(tagged, "resolution_id", "left_semi").withColumn("o", F.struct("chunk_index", "chunk_id"))
    return entities.first_chunks(own, "resolution_id", "o").select("chunk_id", "resolution_id", "page", F.lit(1.0).alias("score"))


@query("SELECT res_no FROM resolutions WHERE year IS NOT DISTINCT FROM '2566' AND session IS NOT DISTINCT FROM NULL UNION ALL SELECT res_no FROM resolutions WHERE year IS NOT DISTINCT FROM '2567' AND session IS NOT DISTINCT FROM '3'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolutions")
    return entities.metadata_filter(r, {"year": "2566", "session": None}).select("res_no").union(entities.metadata_filter(r, {"year": "2567", "session": "3"}).select("res_no"))
