"""Studies over rankings: rerankers as a term, profiles, agreement, training groups, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.operators import dictionaries, fusion, metrics
from kosha.plans.ranking_queries import _BASE, _PER, _scores
from kosha.plans.registry import query
from kosha.session import literal_rows, stored, table

_W = "0.3"


@query(f"""WITH {_BASE}, s AS (SELECT combination_id, query_id, rank, score, row_number() OVER (PARTITION BY combination_id, query_id ORDER BY score DESC NULLS LAST, rank) AS ce FROM r WHERE rank <= 10)
SELECT combination_id, query_id, rank, round((1 - {_W}::DOUBLE) / (60 + rank) + {_W}::DOUBLE / (60 + ce), 9) AS fused FROM s""")
def reranker_term(spark: SparkSession, d: str) -> DataFrame:
    """A second ranking of the pool as one more reciprocal-rank term."""
    r = metrics.cleaned(table(spark, d, "rankings")).filter("rank <= 10")
    ce = F.row_number().over(Window.partitionBy("combination_id", "query_id").orderBy(F.col("score").desc_nulls_last(), "rank"))
    w = float(_W)
    return r.withColumn("ce", ce).select("combination_id", "query_id", "rank", F.round((1 - F.lit(w)) / (fusion.RRF + F.col("rank")) + F.lit(w) / (fusion.RRF + F.col("ce")), 9).alias("fused"))


@query(f"""WITH {_BASE} SELECT combination_id, count_if(score > 0 AND rank > 5) AS positive_cut, count_if(score = 0 AND rank > 5) AS zero_cut, count_if(score < 0 AND rank > 5) AS negative_cut, round(sum(CASE WHEN rank > 5 THEN abs(score) ELSE 0 END) / nullif(sum(abs(score)), 0), 5) AS mass_cut FROM r GROUP BY 1""")
def cut_profile(spark: SparkSession, d: str) -> DataFrame:
    """What a cut at depth 5 takes away: positive, zero and negative scores, and their share of the mass."""
    s, deep = F.col("score"), F.col("rank") > 5
    return metrics.cleaned(table(spark, d, "rankings")).groupBy("combination_id").agg(F.count_if((s > 0) & deep).alias("positive_cut"), F.count_if((s == 0) & deep).alias("zero_cut"), F.count_if((s < 0) & deep).alias("negative_cut"), F.round(F.try_divide(F.sum(F.when(deep, F.abs(s)).otherwise(0.0)), F.sum(F.abs(s))), 5).alias("mass_cut"))


@query("""WITH f AS (SELECT DISTINCT field FROM programs), m AS (SELECT res_no, field FROM resolutions JOIN f ON contains(title, field)) SELECT res_no, field FROM m WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.res_no = m.res_no AND x.field <> m.field AND contains(x.field, m.field))""")
def field_matches(spark: SparkSession, d: str) -> DataFrame:
    """Fields named by titles, without those that are part of a longer one named there; the list of fields has a fixed size."""
    fields = literal_rows(table(spark, d, "programs").select("field").distinct())["field"]
    r = table(spark, d, "resolutions").filter("title is not null").select("res_no", "title")
    hit = F.filter(fields, lambda f: F.contains("title", f))
    kept = r.withColumn("hit", hit).withColumn("kept", F.filter("hit", lambda f: ~F.exists("hit", lambda g: (g != f) & F.contains(g, f))))
    return kept.select("res_no", F.explode("kept").alias("field"))


@query(f"WITH {_PER}, c AS (SELECT query_id, split_part(combination_id, '-', 1) AS family, avg(recall_10) AS v FROM m GROUP BY 1, 2) SELECT family, count(*) AS n, round(avg(v), 6) AS nested_mean FROM c GROUP BY 1")
def nested_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean over queries of the mean within a family of combinations."""
    s = _scores(spark, d).groupBy("query_id", F.split("combination_id", "-")[0].alias("family")).agg(F.avg("recall_10").alias("v"))
    return s.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("nested_mean"))


@query("""WITH t AS (SELECT f, res_no % 2 AS half, y, count(*) AS n FROM (SELECT res_no, unnest(faculties) AS f, year AS y FROM resolutions) WHERE f IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
b AS (SELECT f, half, y FROM (SELECT *, row_number() OVER (PARTITION BY f, half ORDER BY n DESC, y) AS r FROM t) WHERE r = 1) SELECT a.f AS faculty, a.y AS first, c.y AS second, a.y = c.y AS agree FROM b a JOIN b c ON a.f = c.f AND a.half = 0 AND c.half = 1""")
def split_half(spark: SparkSession, d: str) -> DataFrame:
    """The commonest year of each faculty tag in either half of the corpus, and whether they agree."""
    t = table(spark, d, "resolutions").select((F.col("res_no") % 2).alias("half"), F.explode("faculties").alias("faculty"), F.col("year").alias("y")).filter("faculty is not null and y is not null")
    n = t.groupBy("faculty", "half", "y").agg(F.count("*").alias("n"))
    best = stored(n.withColumn("r", F.row_number().over(Window.partitionBy("faculty", "half").orderBy(F.col("n").desc(), "y"))).filter("r = 1"))
    a, b = best.filter("half = 0").select("faculty", F.col("y").alias("first")), best.filter("half = 1").select("faculty", F.col("y").alias("second"))
    return a.join(b, "faculty").withColumn("agree", F.col("first") == F.col("second"))


@query("""WITH q AS (SELECT DISTINCT query_id, resolution_id FROM qrels), m AS (SELECT query_id, count(DISTINCT r.year || '/' || r.session) AS n, min(r.year || '/' || r.session) AS meeting FROM q JOIN (SELECT resolution_id, min(year) AS year, min(session) AS session FROM resolutions GROUP BY 1) r USING (resolution_id) GROUP BY 1)
SELECT query_id, CASE WHEN n = 1 THEN query || ' (' || meeting || ')' ELSE query END AS qualified FROM queries LEFT JOIN m USING (query_id)""")
def qualified_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries with the meeting that their judgements agree on; others as they are."""
    r = table(spark, d, "resolutions").groupBy("resolution_id").agg(F.min("year").alias("year"), F.min("session").alias("session"))
    q = table(spark, d, "qrels").select("query_id", "resolution_id").distinct().join(r, "resolution_id").withColumn("m", F.concat("year", F.lit("/"), "session"))
    m = q.groupBy("query_id").agg(F.count_distinct("m").alias("n"), F.min("m").alias("meeting"))
    both = table(spark, d, "queries").select("query_id", "query").join(m, "query_id", "left")
    return both.select("query_id", F.when(F.col("n") == 1, F.concat("query", F.lit(" ("), "meeting", F.lit(")"))).otherwise(F.col("query")).alias("qualified"))


@query(f"""WITH {_BASE}, f AS (SELECT min(combination_id) AS f FROM r), x AS (SELECT * FROM r WHERE combination_id = (SELECT f FROM f)) SELECT r.combination_id, count(*) AS n, count_if(r.chunk_id IS NOT DISTINCT FROM x.chunk_id) AS same_place, round(max(abs(r.score - x.score)), 6) AS worst_gap FROM r JOIN x ON r.query_id = x.query_id AND r.rank = x.rank WHERE r.combination_id <> x.combination_id GROUP BY 1""")
def order_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Each combination against the first one, rank by rank."""
    r = stored(metrics.cleaned(table(spark, d, "rankings")))
    first = r.agg(F.min("combination_id").alias("f")).first()["f"]
    x = r.filter(F.col("combination_id") == first).select("query_id", "rank", F.col("chunk_id").alias("c0"), F.col("score").alias("s0"))
    both = r.filter(F.col("combination_id") != first).join(x, ["query_id", "rank"])
    return both.groupBy("combination_id").agg(F.count("*").alias("n"), F.count_if(F.col("chunk_id").eqNullSafe(F.col("c0"))).alias("same_place"), F.round(F.max(F.abs(F.col("score") - F.col("s0"))), 6).alias("worst_gap"))


@query(f"""WITH {_BASE}, u AS (SELECT DISTINCT query_id, resolution_id FROM r WHERE resolution_id IS NOT NULL), l AS (SELECT u.*, q.query_id IS NOT NULL AS pos FROM u LEFT JOIN q USING (query_id, resolution_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY md5(query_id::VARCHAR || ':' || resolution_id), resolution_id) AS o FROM l), p AS (SELECT query_id, resolution_id AS positive, o FROM k WHERE pos AND o <= 4), n AS (SELECT query_id, list(resolution_id ORDER BY o) AS negatives FROM k WHERE NOT pos AND o <= 7 GROUP BY 1)
SELECT query_id, positive, negatives FROM p JOIN n USING (query_id)""")
def training_groups(spark: SparkSession, d: str) -> DataFrame:
    """Listwise groups: up to four positives of each query, each with seven negatives, by hash order (sampling is the feature)."""
    u = metrics.cleaned(table(spark, d, "rankings")).filter("resolution_id is not null").select("query_id", "resolution_id").distinct()
    label = u.join(metrics.judged(table(spark, d, "qrels")).withColumn("rel", F.lit(True)), ["query_id", "resolution_id"], "left").withColumn("pos", F.coalesce("rel", F.lit(False)))
    h = F.md5(F.concat_ws(":", F.col("query_id").cast("string"), "resolution_id"))
    k = stored(label.withColumn("o", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy(h, "resolution_id"))).filter("o <= 7"))
    n = k.filter("not pos").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "resolution_id")))["resolution_id"].alias("negatives"))
    return k.filter("pos and o <= 4").select("query_id", F.col("resolution_id").alias("positive")).join(n, "query_id")


@query("""WITH n AS (SELECT q.query_id, r.resolution_id FROM queries q JOIN (SELECT DISTINCT resolution_id, title FROM resolutions) r ON q.entity <> '' AND contains(r.title, q.entity)), j AS (SELECT DISTINCT query_id, resolution_id FROM qrels)
SELECT query_id, count(DISTINCT n.resolution_id) AS naming, count(DISTINCT CASE WHEN j.resolution_id IS NOT NULL THEN n.resolution_id END) AS judged, CASE WHEN count(DISTINCT n.resolution_id) = 0 THEN NULL ELSE round(count(DISTINCT CASE WHEN j.resolution_id IS NOT NULL THEN n.resolution_id END)::DOUBLE / count(DISTINCT n.resolution_id), 6) END AS anchor_precision
FROM queries LEFT JOIN n USING (query_id) LEFT JOIN j USING (query_id, resolution_id) GROUP BY 1""")
def anchor_precision(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents that name a query's entity, the share judged relevant; undefined without any."""
    q = table(spark, d, "queries").select("query_id", "entity")
    r = table(spark, d, "resolutions").select("res_no", "resolution_id", "title")
    found = dictionaries.mentions(r, "res_no", "title", q, "entity", flat=False, alone=False).join(r.select("res_no", "resolution_id"), "res_no").join(q, "entity")
    named = found.select("query_id", "resolution_id").distinct().join(metrics.judged(table(spark, d, "qrels")).withColumn("rel", F.lit(1)), ["query_id", "resolution_id"], "left")
    per = named.groupBy("query_id").agg(F.count("*").alias("naming"), F.count("rel").alias("judged"))
    out = q.select("query_id").join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("query_id", zero("naming").alias("naming"), zero("judged").alias("judged"), F.round(F.try_divide(F.col("judged").cast("double"), F.col("naming").cast("double")), 6).alias("anchor_precision"))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), q AS (SELECT event_type, max(n) AS plateau, round(avg(n), 6) AS mean FROM h GROUP BY 1) SELECT event_type, plateau, mean, round((SELECT 1 / sum(1 / mean) FROM q), 5) AS composed FROM q""")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    """The greatest hourly rate of each event type, its mean, and the rate of all types one after the other."""
    h = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"))
    q = h.groupBy("event_type").agg(F.max("n").alias("plateau"), F.round(F.avg("n"), 6).alias("mean"))
    total = stored(q).agg(F.try_divide(F.lit(1.0), F.sum(1 / F.col("mean"))).alias("c")).first()["c"]
    return q.select("event_type", "plateau", "mean", F.round(F.lit(total).cast("double"), 5).alias("composed"))
