"""Evaluation of stored rankings, and statistics over it, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.operators import metrics, stats
from kosha.plans.registry import query
from kosha.session import built, stored, table

KS = (5, 10)

_BASE = """
r AS (SELECT combination_id, query_id, rank, chunk_id, resolution_id, page, score, retriever FROM (SELECT *, row_number() OVER (PARTITION BY combination_id, query_id, rank ORDER BY chunk_id NULLS FIRST, resolution_id NULLS FIRST, score NULLS FIRST) AS o FROM rankings) WHERE o = 1),
q AS (SELECT DISTINCT query_id, resolution_id FROM qrels WHERE resolution_id IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY combination_id, query_id ORDER BY rank, resolution_id) AS hit_no FROM (SELECT combination_id, query_id, resolution_id, min(rank) AS rank FROM r JOIN q USING (query_id, resolution_id) GROUP BY ALL)),
g AS (SELECT combination_id, query_id, n_rel FROM (SELECT DISTINCT combination_id FROM rankings), (SELECT query_id, count(*) AS n_rel FROM q GROUP BY 1))"""
_PER = f"""{_BASE},
f AS (SELECT combination_id, query_id, min(rank) AS first, {', '.join(f'count_if(rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN hit_no::DOUBLE / rank ELSE 0 END) AS a{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS d{k}' for k in KS)} FROM h GROUP BY ALL),
m AS (SELECT combination_id, query_id, n_rel, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, {', '.join(f'round(coalesce(h{k}, 0)::DOUBLE / n_rel, 6) AS recall_{k}, round(coalesce(h{k}, 0)::DOUBLE / {k}, 6) AS precision_{k}, round(coalesce(a{k}, 0) / n_rel, 6) AS ap_{k}, round(coalesce(d{k}, 0) / list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}' for k in KS)} FROM g LEFT JOIN f USING (combination_id, query_id))"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of every ranking; some twenty queries read them, so they are stored once."""
    return built(spark, "scores", d, lambda: metrics.per_query(metrics.cleaned(table(spark, d, "rankings")), table(spark, d, "qrels"), KS))


@query(f"WITH {_PER} SELECT * FROM m")
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"WITH {_PER} SELECT combination_id, round(avg(rr), 5) AS rr, {', '.join(f'round(avg({m}_{k}), 5) AS {m}_{k}' for k in KS for m in ('recall', 'precision', 'ndcg'))}, round(avg(ap_10), 5) AS ap_10 FROM m GROUP BY 1")
def evaluate_multi_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(_scores(spark, d), KS)


@query(f"WITH {_PER} SELECT combination_id, round(avg(recall_10), 5) AS macro, round(sum(recall_10 * n_rel) / sum(n_rel), 5) AS micro, round(avg(least(1.0, 10.0::DOUBLE / n_rel)), 5) AS ceiling FROM m GROUP BY 1")
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.groupBy("combination_id").agg(F.round(F.avg("recall_10"), 5).alias("macro"), F.round(F.sum(F.col("recall_10") * F.col("n_rel")) / F.sum("n_rel"), 5).alias("micro"), F.round(F.avg(F.least(F.lit(1.0), 10.0 / F.col("n_rel"))), 5).alias("ceiling"))


@query(f"WITH {_PER} SELECT combination_id, entity_type, grouping(combination_id, entity_type) AS level, count(*) AS n, round(avg(recall_10), 5) AS recall_10 FROM m JOIN queries USING (query_id) GROUP BY CUBE (combination_id, entity_type)")
def recall_cube(spark: SparkSession, d: str) -> DataFrame:
    """Means by combination and entity type, with all margins in one pass."""
    s = _scores(spark, d).join(table(spark, d, "queries").select("query_id", "entity_type"), "query_id")
    return s.cube("combination_id", "entity_type").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("recall_10"), 5).alias("recall_10"))


@query(f"WITH {_PER} SELECT query_id, {', '.join(f'round(max(recall_{k}), 6) AS best_{k}' for k in KS)} FROM m GROUP BY 1")
def best_by_k(spark: SparkSession, d: str) -> DataFrame:
    """A column per k, by pivoting the long form."""
    long = _scores(spark, d).select("query_id", F.explode(F.create_map(*[x for k in KS for x in (F.lit(k), F.col(f"recall_{k}"))])).alias("k", "recall"))
    return long.groupBy("query_id").pivot("k", list(KS)).agg(F.round(F.max("recall"), 6)).select("query_id", *[F.col(str(k)).alias(f"best_{k}") for k in KS])


@query(f"WITH {_BASE}, u AS (SELECT DISTINCT query_id, resolution_id FROM r WHERE rank <= 10), n AS (SELECT query_id, count(*) AS n_rel FROM q GROUP BY 1) SELECT query_id, n_rel, count(u.resolution_id) AS found, round(count(u.resolution_id)::DOUBLE / n_rel, 6) AS ceiling FROM q JOIN n USING (query_id) LEFT JOIN u USING (query_id, resolution_id) GROUP BY 1, 2")
def oracle_union(spark: SparkSession, d: str) -> DataFrame:
    """What all systems' first ten find together, of what is relevant."""
    union = metrics.cleaned(table(spark, d, "rankings")).filter("rank <= 10").select("query_id", "resolution_id").distinct().withColumn("hit", F.lit(1))
    q = metrics.judged(table(spark, d, "qrels"))
    return q.join(union, ["query_id", "resolution_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_rel"), F.count("hit").alias("found")).withColumn("ceiling", F.round(F.col("found") / F.col("n_rel"), 6))


@query(f"""WITH {_BASE}, p AS (SELECT c.combination_id, q.query_id, q.resolution_id, h.rank FROM (SELECT DISTINCT combination_id FROM rankings) c CROSS JOIN q LEFT JOIN h USING (combination_id, query_id, resolution_id))
SELECT combination_id, CASE WHEN rank IS NULL THEN 'none' WHEN rank <= 10 THEN '1-10' WHEN rank <= 50 THEN '11-50' WHEN rank <= 100 THEN '51-100' WHEN rank <= 1000 THEN '101-1000' ELSE '1001+' END AS band, count(*) AS n FROM p GROUP BY ALL""")
def miss_depth_bands(spark: SparkSession, d: str) -> DataFrame:
    """Found ones by depth from the hits; the rest by subtraction, so that no grid is formed."""
    q, r = stored(metrics.judged(table(spark, d, "qrels"))), table(spark, d, "rankings")
    hits = metrics.first_hits(metrics.cleaned(r), q)
    found = hits.groupBy("combination_id", metrics.depth_band(F.col("rank")).alias("band")).agg(F.count("*").alias("n"))
    total = q.count()
    per = r.select("combination_id").distinct().join(found.groupBy("combination_id").agg(F.sum("n").alias("f")), "combination_id", "left").select("combination_id", F.lit("none").alias("band"), (F.lit(total) - F.coalesce("f", F.lit(0))).alias("n"))
    return found.union(per.filter("n > 0"))


@query(f"WITH {_PER}, a AS (SELECT combination_id, round(avg(recall_10), 6) AS recall_10, entity_type FROM m JOIN queries USING (query_id) GROUP BY 1, 3) SELECT entity_type, combination_id, recall_10 FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY recall_10 DESC, combination_id) AS o FROM a) WHERE o = 1")
def argmax_combo(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).join(table(spark, d, "queries").select("query_id", "entity_type"), "query_id")
    means = s.groupBy("combination_id", "entity_type").agg(F.round(F.avg("recall_10"), 6).alias("recall_10"))
    return metrics.argmax(means, ["entity_type"], "combination_id", "recall_10").select("entity_type", "combination_id", "recall_10")


@query(f"""WITH {_PER}, o AS (SELECT query_id, combination_id, recall_10, round((sum(recall_10) OVER w - recall_10) / nullif(count(*) OVER w - 1, 0), 6) AS others FROM m WINDOW w AS (PARTITION BY combination_id))
SELECT query_id, combination_id, recall_10, others FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY others DESC NULLS LAST, combination_id) AS x FROM o) WHERE x = 1""")
def loo_select(spark: SparkSession, d: str) -> DataFrame:
    return metrics.leave_one_out(_scores(spark, d), "query_id", "combination_id", "recall_10")


@query(f"WITH {_BASE} SELECT combination_id, query_id, resolution_id, min(rank) AS rank, row_number() OVER (PARTITION BY combination_id, query_id ORDER BY min(rank), resolution_id) AS doc_rank FROM r WHERE resolution_id IS NOT NULL GROUP BY 1, 2, 3")
def dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of documents: the first chunk of each, ranks anew."""
    best = metrics.cleaned(table(spark, d, "rankings")).filter("resolution_id is not null").groupBy("combination_id", "query_id", "resolution_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("doc_rank", F.row_number().over(Window.partitionBy("combination_id", "query_id").orderBy("rank", "resolution_id")))


@query(f"WITH {_BASE} SELECT r.query_id, r.resolution_id, count(DISTINCT combination_id) AS n_systems, min(rank) AS best FROM r ANTI JOIN q USING (query_id, resolution_id) WHERE rank <= 10 AND resolution_id IS NOT NULL GROUP BY 1, 2")
def unjudged(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.cleaned(table(spark, d, "rankings")).filter("rank <= 10 and resolution_id is not null")
    return r.join(metrics.judged(table(spark, d, "qrels")), ["query_id", "resolution_id"], "left_anti").groupBy("query_id", "resolution_id").agg(F.count_distinct("combination_id").alias("n_systems"), F.min("rank").alias("best"))


@query(f"WITH {_BASE}, w AS (SELECT *, min(rank) OVER (PARTITION BY combination_id, query_id, resolution_id) AS fr FROM r), t AS (SELECT w.*, q.query_id IS NOT NULL AND w.rank = fr AS hit FROM w LEFT JOIN q ON q.query_id = w.query_id AND q.resolution_id = w.resolution_id) SELECT combination_id, query_id, rank, resolution_id, row_number() OVER (PARTITION BY combination_id, query_id ORDER BY hit DESC, rank) AS new_rank FROM t")
def oracle_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The best order of what was retrieved: one chunk of each relevant document first, then the rest as it was."""
    r = metrics.cleaned(table(spark, d, "rankings"))
    q = metrics.judged(table(spark, d, "qrels")).withColumn("rel", F.lit(True))
    first = F.col("rank") == F.min("rank").over(Window.partitionBy("combination_id", "query_id", "resolution_id"))
    hit = F.coalesce(F.col("rel"), F.lit(False)) & first
    ranked = r.join(q, ["query_id", "resolution_id"], "left").withColumn("hit", hit)
    return ranked.select("combination_id", "query_id", "rank", "resolution_id", F.row_number().over(Window.partitionBy("combination_id", "query_id").orderBy(F.col("hit").desc(), "rank")).alias("new_rank"))


@query(f"""WITH {_BASE}, a AS (SELECT DISTINCT combination_id, query_id, resolution_id FROM r WHERE rank <= 10 AND resolution_id IS NOT NULL), n AS (SELECT combination_id, query_id, count(*) AS n FROM a GROUP BY ALL),
s AS (SELECT x.combination_id AS a, y.combination_id AS b, x.query_id, count(*) AS shared FROM a x JOIN a y ON x.query_id = y.query_id AND x.resolution_id = y.resolution_id AND x.combination_id < y.combination_id GROUP BY ALL)
SELECT a, b, count(*) AS n_queries, round(avg(shared::DOUBLE / least(m.n, o.n)), 6) AS agreement FROM s JOIN n m ON m.combination_id = a AND m.query_id = s.query_id JOIN n o ON o.combination_id = b AND o.query_id = s.query_id GROUP BY ALL""")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Documents shared by two systems' first ten; a document is found by at most as many rows as there are systems."""
    a = stored(metrics.cleaned(table(spark, d, "rankings")).filter("rank <= 10 and resolution_id is not null").select("combination_id", "query_id", "resolution_id").distinct())
    n = a.groupBy("combination_id", "query_id").agg(F.count("*").alias("n"))
    lists = a.groupBy("query_id", "resolution_id").agg(F.array_sort(F.collect_set("combination_id")).alias("c"))
    pairs = lists.select("query_id", F.col("c"), F.posexplode("c").alias("i", "a")).select("query_id", "a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    s = pairs.groupBy("a", "b", "query_id").agg(F.count("*").alias("shared"))
    x = n.select(F.col("combination_id").alias("a"), "query_id", F.col("n").alias("na"))
    y = n.select(F.col("combination_id").alias("b"), "query_id", F.col("n").alias("nb"))
    return s.join(x, ["a", "query_id"]).join(y, ["b", "query_id"]).groupBy("a", "b").agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("shared") / F.least("na", "nb")), 6).alias("agreement"))


@query(f"""WITH {_BASE}, t AS (SELECT combination_id, query_id, rank, score FROM r WHERE score IS NOT NULL AND rank <= 10), p AS (SELECT x.combination_id, x.query_id, sign(x.rank - y.rank) AS sx, sign(x.score - y.score) AS sy FROM t x JOIN t y ON x.combination_id = y.combination_id AND x.query_id = y.query_id AND x.rank < y.rank)
SELECT combination_id, query_id, round(sum(sx * sy)::DOUBLE / nullif(sqrt(sum(sx * sx)::DOUBLE * sum(sy * sy)), 0), 6) AS tau FROM p GROUP BY ALL""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    t = stored(metrics.cleaned(table(spark, d, "rankings")).filter("score is not null and rank <= 10").select("combination_id", "query_id", "rank", "score"))
    return stats.kendall(t, ["combination_id", "query_id"], "rank", "score", "rank")


_DIFFS = f"""{_PER}, o AS (SELECT combination_id, row_number() OVER (ORDER BY combination_id) AS o FROM (SELECT DISTINCT combination_id FROM m)),
b AS (SELECT query_id, recall_10 AS base FROM m WHERE combination_id = (SELECT combination_id FROM o WHERE o = 1)),
df AS (SELECT combination_id, query_id, round(recall_10 - base, 6) AS diff FROM m JOIN b USING (query_id) WHERE combination_id <> (SELECT combination_id FROM o WHERE o = 1))"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each combination less that of the first one, by query."""
    s = stored(_scores(spark, d))
    first = s.agg(F.min("combination_id").alias("f")).first()["f"]
    base = s.filter(F.col("combination_id") == first).select("query_id", F.col("recall_10").alias("base"))
    return s.filter(F.col("combination_id") != first).join(base, "query_id").select("combination_id", "query_id", F.round(F.col("recall_10") - F.col("base"), 6).alias("diff"))


N_BOOT = 10_000
_BOOT = f"""{_DIFFS}, l AS (SELECT combination_id, list((sign(diff) * floor(abs(diff) * 1e6 + 0.5))::BIGINT ORDER BY query_id) AS vs, count(*) AS n, avg(diff) AS mean FROM df GROUP BY 1),
dr AS (SELECT n, b, list_transform(range(0, n), lambda i: {stats.draws_sql('b', 'i', 'n')} + 1) AS js FROM (SELECT DISTINCT n FROM l), (SELECT unnest(range(0, {N_BOOT}))::BIGINT AS b)),
bm AS (SELECT combination_id, n, mean, round(list_sum(list_select(vs, js))::DOUBLE / n / 1e6, 9) AS m FROM l JOIN dr USING (n)),
bo AS (SELECT combination_id, n::INT AS n, round(any_value(mean), 6) AS mean, round(least(1.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT))), 6) AS p, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM bm GROUP BY 1, 2)"""


@query(f"WITH {_BOOT} SELECT * FROM bo")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap(_diffs(spark, d), "combination_id", "query_id", "diff", N_BOOT)


@query(f"WITH {_BOOT}, st AS (SELECT combination_id, p, (count(*) OVER () - row_number() OVER (ORDER BY p, combination_id) + 1) * p AS step FROM bo), ad AS (SELECT combination_id, p, round(least(1.0, max(step) OVER (ORDER BY p, combination_id ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM st) SELECT combination_id, p, adjusted, adjusted <= 0.05 AS reject FROM ad")
def holm(spark: SparkSession, d: str) -> DataFrame:
    boot = stats.bootstrap(_diffs(spark, d), "combination_id", "query_id", "diff", N_BOOT).select("combination_id", "p", F.lit("recall").alias("family"))
    return stats.holm(boot, ["family"], "combination_id", "p").drop("family")


@query(f"WITH {_DIFFS} SELECT combination_id, round(stddev_samp(diff), 6) AS sd, round(avg(diff) / nullif(stddev_samp(diff) / sqrt(count(*)), 0), 5) AS t FROM df GROUP BY 1")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    df = _diffs(spark, d).groupBy("combination_id").agg(F.stddev_samp("diff").alias("sd"), F.avg("diff").alias("mean"), F.count("*").alias("n"))
    return df.select("combination_id", F.round("sd", 6).alias("sd"), F.round(F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")), 5).alias("t"))


@query(f"WITH {_DIFFS}, v AS (SELECT combination_id, stddev_samp(diff) AS sd, count(*) AS n FROM df GROUP BY 1), z AS (SELECT *, sqrt(-2 * ln(0.025 / (SELECT count(*) FROM v))) AS t FROM v) SELECT combination_id, round((t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) + 0.8416212) * sd / sqrt(n), 6) AS mde FROM z")
def mde(spark: SparkSession, d: str) -> DataFrame:
    v = stored(_diffs(spark, d).groupBy("combination_id").agg(F.stddev_samp("diff").alias("sd"), F.count("*").alias("n")))
    return v.select("combination_id", F.round(stats.mde(F.col("sd"), F.col("n"), tests=max(1, v.count())), 6).alias("mde"))


@query(f"WITH {_PER} SELECT a.combination_id AS a, b.combination_id AS b, round(corr(a.ndcg_10, b.ndcg_10), 5) AS pearson FROM m a JOIN m b ON a.query_id = b.query_id AND a.combination_id < b.combination_id GROUP BY 1, 2 HAVING stddev_pop(a.ndcg_10) > 0 AND stddev_pop(b.ndcg_10) > 0")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of two systems over the judged queries; none where one doesn't vary."""
    s = _scores(spark, d).select("combination_id", "query_id", "ndcg_10", F.lit("").alias("all"))
    dealt = stats.blocks(s, "all", "combination_id", "query_id", "ndcg_10", varied=True)
    figures = stats.paired(dealt, "all", "combination_id", ["pearson"], stats.correlated)
    return stats.pairs(figures, dealt, "all", "combination_id", ["pearson"]).select("a", "b", "pearson")


@query(f"WITH {_BASE}, t AS (SELECT retriever, count(*) AS n, count_if(EXISTS (SELECT 1 FROM q WHERE q.query_id = r.query_id AND q.resolution_id = r.resolution_id)) AS hits FROM r GROUP BY 1) SELECT retriever, n, hits, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - half, 6) AS low, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + half, 6) AS high FROM (SELECT *, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS half FROM (SELECT *, hits::DOUBLE / n AS p FROM t))")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    """The share of relevant rows by retriever with its interval."""
    r = metrics.cleaned(table(spark, d, "rankings")).join(metrics.judged(table(spark, d, "qrels")).withColumn("rel", F.lit(1)), ["query_id", "resolution_id"], "left")
    t = r.groupBy("retriever").agg(F.count("*").alias("n"), F.count("rel").alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return t.select("retriever", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("""WITH c AS (SELECT source, count(*) AS size FROM documents GROUP BY 1) SELECT doc_id, source FROM (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents JOIN c USING (source)) WHERE r <= greatest(1, round(100.0::DOUBLE * size / (SELECT count(*) FROM documents)))""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of about a hundred documents in the sources' shares (sampling is the feature)."""
    return stats.stratified(table(spark, d, "documents").filter("source is not null").select("doc_id", "source"), "source", "doc_id", 100)


@query(f"""WITH {_BASE}, n AS (SELECT combination_id, query_id, count(*) AS n, max(rank) AS last FROM r GROUP BY ALL) SELECT combination_id, count(*) AS n_queries, count_if(n <> last) AS with_gaps, count_if(n < 10) AS truncated FROM n GROUP BY 1""")
def audit_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Rankings with missing ranks or fewer than ten rows."""
    n = metrics.cleaned(table(spark, d, "rankings")).groupBy("combination_id", "query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last"))
    return n.groupBy("combination_id").agg(F.count("*").alias("n_queries"), F.count_if(F.col("n") != F.col("last")).alias("with_gaps"), F.count_if(F.col("n") < 10).alias("truncated"))


@query(f"""WITH {_BASE}, t AS (SELECT combination_id, query_id, round(score, 6) AS s, count(*) AS n FROM r WHERE score IS NOT NULL GROUP BY ALL) SELECT combination_id, sum(n)::BIGINT AS n_rows, count_if(n > 1) AS tie_groups, max(n) AS biggest FROM t GROUP BY 1""")
def score_ties(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.cleaned(table(spark, d, "rankings")).filter("score is not null").groupBy("combination_id", "query_id", F.round("score", 6).alias("s")).agg(F.count("*").alias("n"))
    return t.groupBy("combination_id").agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("tie_groups"), F.max("n").alias("biggest"))


@query(f"""WITH {_BASE}, x AS (SELECT *, dense_rank() OVER (PARTITION BY combination_id, query_id ORDER BY fr) AS label FROM (SELECT *, min(rank) OVER (PARTITION BY combination_id, query_id, resolution_id) AS fr FROM r WHERE resolution_id IS NOT NULL)),
y AS (SELECT * FROM x ANTI JOIN (SELECT combination_id, query_id, min(rank) AS cut FROM x WHERE label = 4 GROUP BY ALL) e ON x.combination_id = e.combination_id AND x.query_id = e.query_id AND x.rank > e.cut),
b AS (SELECT combination_id, query_id, label, resolution_id, substring(string_agg(coalesce(text, ''), chr(10) ORDER BY rank), 1, 4000) AS t FROM y LEFT JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1) USING (chunk_id) WHERE label <= 3 GROUP BY ALL)
SELECT combination_id, query_id, label::INT AS label, resolution_id, length(t) AS n_chars, md5(t) AS block, q.query_id IS NOT NULL AS is_gold, bool_or(q.query_id IS NOT NULL) OVER (PARTITION BY combination_id, b.query_id) AS context_has_gold FROM b LEFT JOIN q USING (query_id, resolution_id)""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A block of up to 4,000 characters for each of the first three documents; reading a ranking ends at the first hit of a fourth one."""
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text"))
    blocks = metrics.contexts(metrics.cleaned(table(spark, d, "rankings")).join(c, "chunk_id", "left"), metrics.judged(table(spark, d, "qrels")), "text", 3, 4000)
    return blocks.select("combination_id", "query_id", "label", "resolution_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("block"), "is_gold", "context_has_gold")
