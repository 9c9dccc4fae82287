"""Further studies, agreements and checks, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.functions import text as tx
from kosha.operators import dictionaries, metrics, quality, stats
from kosha.plans import corpus_tables
from kosha.plans.ranking_queries import _BASE, _PER, KS, _scores
from kosha.plans.registry import query
from kosha.session import stored, table

_FAMILY = "split_part(combination_id, '-', 1)"
_family = lambda: F.split("combination_id", "-")[0]


@query(f"WITH {_PER}, a AS (SELECT {_FAMILY} AS family, entity_type, query_id, avg(recall_10) AS v FROM m JOIN queries USING (query_id) GROUP BY 1, 2, 3), t AS (SELECT family, entity_type, avg(v) AS v FROM a GROUP BY 1, 2) SELECT x.entity_type, x.family AS a, y.family AS b, round(x.v - y.v, 6) AS diff FROM t x JOIN t y ON x.entity_type = y.entity_type AND x.family < y.family")
def axis_differences(spark: SparkSession, d: str) -> DataFrame:
    """Families of combinations averaged over their members first, then compared by entity type."""
    s = _scores(spark, d).join(table(spark, d, "queries").select("query_id", "entity_type"), "query_id").withColumn("family", _family())
    t = stored(s.groupBy("family", "entity_type", "query_id").agg(F.avg("recall_10").alias("v")).groupBy("family", "entity_type").agg(F.avg("v").alias("v")))
    x, y = t.alias("x"), t.alias("y")
    both = x.join(y, (F.col("x.entity_type") == F.col("y.entity_type")) & (F.col("x.family") < F.col("y.family")))
    return both.select(F.col("x.entity_type").alias("entity_type"), F.col("x.family").alias("a"), F.col("y.family").alias("b"), F.round(F.col("x.v") - F.col("y.v"), 6).alias("diff"))


@query(f"WITH {_PER} SELECT combination_id, {', '.join(f'round(avg(recall_{k}), 6) AS recall_at_{k}' for k in KS)} FROM m GROUP BY 1")
def recall_by_k(spark: SparkSession, d: str) -> DataFrame:
    """The mean recall of each combination, a column per k, by pivoting the long form."""
    long = _scores(spark, d).select("combination_id", F.explode(F.create_map(*[x for k in KS for x in (F.lit(k), F.col(f"recall_{k}"))])).alias("k", "recall"))
    return long.groupBy("combination_id").pivot("k", list(KS)).agg(F.round(F.avg("recall"), 6)).select("combination_id", *[F.col(str(k)).alias(f"recall_at_{k}") for k in KS])


@query(f"WITH {_PER} SELECT query_id, combination_id, recall_10 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY recall_10 DESC, combination_id) AS o FROM m) WHERE o = 1")
def best_per_query(spark: SparkSession, d: str) -> DataFrame:
    return metrics.argmax(_scores(spark, d).select("query_id", "combination_id", "recall_10"), ["query_id"], "combination_id", "recall_10")


@query(f"""WITH {_PER}, t AS (SELECT m.*, entity_type FROM m JOIN queries USING (query_id)), o AS (SELECT entity_type, query_id, combination_id, recall_10, round((sum(recall_10) OVER w - recall_10) / nullif(count(*) OVER w - 1, 0), 6) AS others FROM t WINDOW w AS (PARTITION BY combination_id, entity_type))
SELECT entity_type, query_id, combination_id, recall_10, others FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY others DESC NULLS LAST, combination_id) AS x FROM o) WHERE x = 1""")
def loo_by_route(spark: SparkSession, d: str) -> DataFrame:
    """For each query the combination that is best on the other queries of its type."""
    s = _scores(spark, d).join(table(spark, d, "queries").select("query_id", "entity_type"), "query_id")
    w = Window.partitionBy("combination_id", "entity_type")
    o = s.withColumn("others", F.round(F.try_divide(F.sum("recall_10").over(w) - F.col("recall_10"), F.count("*").over(w) - 1), 6))
    best = o.withColumn("x", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("others").desc_nulls_last(), "combination_id"))).filter("x = 1")
    return best.select("entity_type", "query_id", "combination_id", "recall_10", "others")


@query("""WITH f AS (SELECT DISTINCT canonical AS name FROM faculties), t AS (SELECT res_no, count(*) AS n, min(name) AS name FROM resolutions JOIN f ON contains(title, name) GROUP BY 1), b AS (SELECT res_no, count(*) AS n, min(name) AS name FROM resolutions JOIN f ON contains(raw_text, name) GROUP BY 1)
SELECT t.name AS faculty, count(*) AS n, count(*) FILTER (t.name = b.name) AS agree FROM t JOIN b USING (res_no) WHERE t.n = 1 AND b.n = 1 GROUP BY 1""")
def title_body_votes(spark: SparkSession, d: str) -> DataFrame:
    """Resolutions whose title and whose body name one faculty each: how often it is the same."""
    names = table(spark, d, "faculties").select(F.col("canonical").alias("name"))
    r = table(spark, d, "resolutions")
    one = lambda c: dictionaries.mentions(r, "res_no", c, names, "name", flat=False, alone=False).groupBy("res_no").agg(F.count("*").alias("n"), F.min("name").alias(c)).filter("n = 1").drop("n")
    return one("title").join(one("raw_text"), "res_no").groupBy(F.col("title").alias("faculty")).agg(F.count("*").alias("n"), F.count_if(F.col("title") == F.col("raw_text")).alias("agree"))


_KEY = r"lower(regexp_replace(p, '[ \t\n\r0-9๐-๙().,/-]+', '', 'g'))"


@query(f"WITH t AS (SELECT unnest(programs) AS p FROM resolutions), n AS (SELECT {_KEY} AS key, p, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY 1, 2) SELECT key, arg_min(p, (-n, p)) AS spelling, sum(n)::BIGINT AS n, count(*) AS n_spellings FROM n GROUP BY 1")
def program_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Programme tags that are the same without spaces, digits and signs, under their commonest spelling."""
    t = table(spark, d, "resolutions").select(F.explode("programs").alias("p")).filter("p is not null")
    n = t.groupBy(F.lower(F.regexp_replace("p", r"[ \t\n\r0-9๐-๙().,/-]+", "")).alias("key"), "p").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.min_by("p", F.struct(-F.col("n"), "p")).alias("spelling"), F.sum("n").alias("n"), F.count("*").alias("n_spellings"))


@query("""WITH t AS (SELECT sha256(raw_text) AS hash, string_split(resolution_id, ' — ')[1] AS item, concat_ws('/', year, session) AS meeting FROM resolutions WHERE trim(raw_text) <> '')
SELECT hash, count(*) AS n, CASE WHEN count(DISTINCT item) = 1 THEN 'same item' WHEN count(DISTINCT meeting) = 1 THEN 'same meeting' ELSE 'across meetings' END AS kind FROM t GROUP BY 1 HAVING count(*) > 1""")
def duplicate_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Equal bodies by where they are filed: one item, one meeting, several meetings."""
    t = table(spark, d, "resolutions").filter(F.trim("raw_text") != "").select(F.sha2("raw_text", 256).alias("hash"), tx.event_key(F.col("resolution_id")).alias("item"), F.concat_ws("/", "year", "session").alias("meeting"))
    g = t.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"), F.count_distinct("meeting").alias("meetings")).filter("n > 1")
    return g.select("hash", "n", F.when(F.col("items") == 1, "same item").when(F.col("meetings") == 1, "same meeting").otherwise("across meetings").alias("kind"))


@query("SELECT count(*) AS n_vectors, max(len(embedding)) AS dim, sum(len(embedding)) * 4 AS n_bytes, (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_chunks, (SELECT sum(strlen(t)) FROM (SELECT min(text) AS t FROM chunks GROUP BY chunk_id))::BIGINT AS text_bytes FROM embeddings")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).cast("bigint").alias("dim"), (F.sum(F.size("embedding")) * 4).alias("n_bytes"))
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.min("text").alias("t")).agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("t")).alias("text_bytes"))
    return v.join(c)  # two tables of one row


@query("SELECT CASE WHEN raw_text IS NULL THEN 'null' WHEN trim(raw_text, ' ' || chr(10)) = '' THEN 'blank' WHEN NOT regexp_matches(raw_text, '(?m)^[ ]*[^#< \\n]') THEN 'headings only' ELSE 'text' END AS state, count(*) AS n FROM resolutions GROUP BY 1")
def document_states(spark: SparkSession, d: str) -> DataFrame:
    """Documents without text, with blank text and with headings or tables alone."""
    t = F.col("raw_text")
    state = F.when(t.isNull(), "null").when(F.btrim(t, F.lit(" \n")) == "", "blank").when(~t.rlike(r"(?m)^[ ]*[^#< \n]"), "headings only").otherwise("text")
    return table(spark, d, "resolutions").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT pdf, page, unnest(files) AS f FROM page_results), e AS (SELECT pdf, f, count(*) AS pages FROM m GROUP BY 1, 2), r AS (SELECT source_path, min(source_url) AS url FROM resolutions GROUP BY 1)
SELECT pdf, count(*) AS n_files, count(*) FILTER (r.source_path IS NULL) AS dead, count(DISTINCT url) AS urls, CASE WHEN count(*) FILTER (r.source_path IS NULL) > 0 THEN 'dead entries' WHEN count(DISTINCT url) > 1 THEN 'several urls' ELSE 'ok' END AS status FROM e LEFT JOIN r ON r.source_path = e.f GROUP BY 1""")
def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    """The files that each scanned document lists: missing ones, and links that disagree."""
    e = table(spark, d, "page_results").select("pdf", F.explode("files").alias("source_path")).distinct()
    r = table(spark, d, "resolutions").groupBy("source_path").agg(F.min("source_url").alias("url"), F.lit(1).alias("r"))
    g = e.join(r, "source_path", "left").groupBy("pdf").agg(F.count("*").alias("n_files"), F.count_if(F.col("r").isNull()).alias("dead"), F.count_distinct("url").alias("urls"))
    return g.withColumn("status", F.when(F.col("dead") > 0, "dead entries").when(F.col("urls") > 1, "several urls").otherwise("ok"))


_LISTS = """t AS (SELECT combination_id, query_id, list(chunk_id ORDER BY rank) AS ids FROM r WHERE rank <= 10 AND chunk_id IS NOT NULL GROUP BY 1, 2), o AS (SELECT query_id, ids AS first FROM t WHERE combination_id = (SELECT min(combination_id) FROM t))"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = metrics.cleaned(table(spark, d, "rankings")).filter("rank <= 10 and chunk_id is not null")
    t = stored(r.groupBy("combination_id", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids")))
    first = t.agg(F.min("combination_id").alias("c")).first()["c"]
    return t.filter(F.col("combination_id") != first), t.filter(F.col("combination_id") == first).select("query_id", F.col("ids").alias("first"))


@query(f"WITH {_BASE}, {_LISTS} SELECT combination_id, count(*) AS n, round(avg(len(list_intersect(ids, first)) / 10.0::DOUBLE), 6) AS agree_at_10, count_if(ids = first) AS identical, count_if(ids[1] = first[1]) AS same_first FROM t JOIN o USING (query_id) WHERE combination_id <> (SELECT min(combination_id) FROM t) GROUP BY 1")
def list_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Each combination's first ten against those of the first one: shared, identical in order, same first chunk."""
    t, o = _lists(spark, d)
    both = t.join(o, "query_id")
    return both.groupBy("combination_id").agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.array_intersect("ids", "first")) / 10.0), 6).alias("agree_at_10"), F.count_if(F.col("ids") == F.col("first")).alias("identical"), F.count_if(F.col("ids")[0] == F.col("first")[0]).alias("same_first"))


@query(f"""WITH {_BASE}, s AS (SELECT combination_id, query_id, rank, chunk_id, round(score, 6) AS s, count(*) OVER (PARTITION BY combination_id, query_id, round(score, 6)) AS ties FROM r WHERE score IS NOT NULL AND chunk_id IS NOT NULL), f AS (SELECT query_id, rank, chunk_id AS first FROM s WHERE combination_id = (SELECT min(combination_id) FROM s))
SELECT combination_id, count(*) AS n, count_if(chunk_id <> first AND ties > 1) AS moved_inside, count_if(chunk_id <> first AND ties = 1) AS moved_outside, max(ties) AS biggest_tie FROM s JOIN f USING (query_id, rank) WHERE combination_id <> (SELECT min(combination_id) FROM s) GROUP BY 1""")
def moved_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks at which a combination has another chunk than the first one, inside and outside groups of equal scores."""
    r = metrics.cleaned(table(spark, d, "rankings")).filter("score is not null and chunk_id is not null").withColumn("s", F.round("score", 6))
    s = stored(r.withColumn("ties", F.count("*").over(Window.partitionBy("combination_id", "query_id", "s"))).select("combination_id", "query_id", "rank", "chunk_id", "ties"))
    first = s.agg(F.min("combination_id").alias("c")).first()["c"]
    f = s.filter(F.col("combination_id") == first).select("query_id", "rank", F.col("chunk_id").alias("first"))
    both, moved = s.filter(F.col("combination_id") != first).join(f, ["query_id", "rank"]), F.col("chunk_id") != F.col("first")
    return both.groupBy("combination_id").agg(F.count("*").alias("n"), F.count_if(moved & (F.col("ties") > 1)).alias("moved_inside"), F.count_if(moved & (F.col("ties") == 1)).alias("moved_outside"), F.max("ties").alias("biggest_tie"))


@query(f"""WITH {_BASE}, t AS (SELECT combination_id, query_id, rank, score FROM r WHERE score IS NOT NULL AND rank <= 10), p AS (SELECT x.combination_id, x.query_id, sign(x.rank - y.rank) AS sx, sign(x.score - y.score) AS sy FROM t x JOIN t y ON x.combination_id = y.combination_id AND x.query_id = y.query_id AND x.rank < y.rank),
k AS (SELECT combination_id, query_id, round(sum(sx * sy)::DOUBLE / nullif(sqrt(sum(sx * sx)::DOUBLE * sum(sy * sy)), 0), 6) AS tau FROM p GROUP BY ALL) SELECT combination_id, count(tau) AS n, round(avg(tau), 5) AS mean, min(tau) AS least, max(tau) AS most FROM k GROUP BY 1""")
def tau_summary(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of scores and ranks within the first ten, over the queries of each combination."""
    t = stored(metrics.cleaned(table(spark, d, "rankings")).filter("score is not null and rank <= 10").select("combination_id", "query_id", "rank", "score"))
    k = stats.kendall(t, ["combination_id", "query_id"], "rank", "score", "rank")
    return k.groupBy("combination_id").agg(F.count("tau").alias("n"), F.round(F.avg("tau"), 5).alias("mean"), F.min("tau").alias("least"), F.max("tau").alias("most"))


@query("WITH l AS (SELECT lang, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT lang, count(*) AS n, round(quantile_cont(n::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(n::DOUBLE, 0.99), 6) AS p99, max(n) AS most, " + ", ".join(f"round(avg((n > {c})::INT), 6) AS over_{c}" for c in (256, 512, 1024)) + " FROM l GROUP BY 1")
def length_profile(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of texts by language, and the share that each cap would cut."""
    l = table(spark, d, "documents").filter("text is not null").select("lang", F.length("text").alias("n"))  # noqa: E741
    p = [F.round(F.percentile("n", F.lit(q)), 6).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return l.groupBy("lang").agg(F.count("*").alias("n"), *p, F.max("n").cast("bigint").alias("most"), *[F.round(F.avg((F.col("n") > c).cast("int")), 6).alias(f"over_{c}") for c in (256, 512, 1024)])


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), q AS (SELECT event_type, max(n) AS plateau FROM h GROUP BY 1), t AS (SELECT max(plateau) AS best FROM q) SELECT event_type, round(plateau::DOUBLE / best, 6) AS ratio, CASE WHEN plateau::DOUBLE / best >= 0.9 THEN 'as fast' WHEN plateau::DOUBLE / best >= 0.5 THEN 'slower' ELSE 'far slower' END AS verdict FROM q, t""")
def throughput_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Each event type's best hour against the best of all."""
    h = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n"))
    q = stored(h.groupBy("event_type").agg(F.max("n").alias("plateau")))
    ratio = F.col("plateau") / F.col("best")
    return q.join(F.broadcast(q.agg(F.max("plateau").alias("best")))).select("event_type", F.round(ratio, 6).alias("ratio"), F.when(ratio >= 0.9, "as fast").when(ratio >= 0.5, "slower").otherwise("far slower").alias("verdict"))  # one row


@query("""WITH p AS (SELECT DISTINCT staging_no, pdf, page, new_text FROM page_results), v AS (SELECT pdf, page, new_text, count(*) AS n, sum(count(*)) OVER (PARTITION BY pdf, page) AS total FROM p GROUP BY 1, 2, 3), b AS (SELECT pdf, page, max(n) AS most, min(total)::BIGINT AS total FROM v GROUP BY 1, 2)
SELECT CASE WHEN 2 * most > total THEN 'majority' ELSE 'split' END AS lean, total AS readings, count(*) AS n FROM b GROUP BY 1, 2""")
def reading_votes(spark: SparkSession, d: str) -> DataFrame:
    """Pages by whether one text has most of their readings, against the number of readings."""
    p = table(spark, d, "page_results").select("staging_no", "pdf", "page", "new_text").distinct()
    v = p.groupBy("pdf", "page", "new_text").agg(F.count("*").alias("n")).groupBy("pdf", "page").agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    return v.groupBy(F.when(2 * F.col("most") > F.col("total"), "majority").otherwise("split").alias("lean"), F.col("total").alias("readings")).agg(F.count("*").alias("n"))


@query("SELECT query_id, list_sort(list_distinct(flatten(list_transform(list(resolution_id), lambda x: CASE WHEN contains(x, ' #') THEN [string_split(x, ' #')[1], x] ELSE [x] END)))) AS ids FROM qrels WHERE resolution_id IS NOT NULL GROUP BY 1")
def split_judgements(spark: SparkSession, d: str) -> DataFrame:
    """Judgements in which an id of a repeated title is replaced by two, the title's own and the repeat's."""
    both = F.transform("l", lambda x: F.when(F.contains(x, F.lit(" #")), F.array(F.split(x, " #")[0], x)).otherwise(F.array(x)))
    q = table(spark, d, "qrels").filter("resolution_id is not null").groupBy("query_id").agg(F.collect_set("resolution_id").alias("l"))
    return q.select("query_id", F.array_sort(F.array_distinct(F.flatten(both))).alias("ids"))


@query("WITH t AS (SELECT res_no, 'faculty' AS kind, unnest(faculties) AS tag FROM resolutions UNION ALL SELECT res_no, 'program', unnest(programs) FROM resolutions), n AS (SELECT * FROM t WHERE tag IS NOT NULL) SELECT kind, grouping(kind) AS level, count(*) AS n, count(DISTINCT tag) AS n_tags, round(count(*)::DOUBLE / (SELECT count(*) FROM resolutions), 6) AS per_document FROM n GROUP BY GROUPING SETS ((kind), ())")
def tag_averages(spark: SparkSession, d: str) -> DataFrame:
    """Tags by kind and over both, and their average per document."""
    r = table(spark, d, "resolutions")
    t = r.select("res_no", F.lit("faculty").alias("kind"), F.explode("faculties").alias("tag")).union(r.select("res_no", F.lit("program"), F.explode("programs"))).filter("tag is not null")
    total = r.agg(F.count("*").alias("total"))  # one row
    g = t.cube("kind").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_distinct("tag").alias("n_tags"))
    return g.join(F.broadcast(total)).select("kind", "level", "n", "n_tags", F.round(F.col("n") / F.col("total"), 6).alias("per_document"))


@query(f"WITH {_PER}, l AS (SELECT combination_id, query_id, unnest(['recall', 'precision', 'ap']) AS metric, unnest([recall_10, precision_10, ap_10]) AS v FROM m) SELECT {_FAMILY} AS family, metric, count(*) AS n, round(avg(v), 6) AS mean FROM l GROUP BY 1, 2")
def metric_scores(spark: SparkSession, d: str) -> DataFrame:
    """Means by family and metric in the long form."""
    long = _scores(spark, d).select("combination_id", F.explode(F.create_map(*[x for n in ("recall", "precision", "ap") for x in (F.lit(n), F.col(f"{n}_10"))])).alias("metric", "v"))
    return long.groupBy(_family().alias("family"), "metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(r"SELECT res_no, trim(regexp_replace(replace(nfc_normalize(title), chr(160), ' '), '[ \t\n\r]+', ' ', 'g'), ' ') AS flat FROM resolutions")
def flat_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles composed, with ordinary spaces, each run of them one."""
    return table(spark, d, "resolutions").select("res_no", tx.collapse_ws(tx.nfc(F.col("title"))).alias("flat"))


@query("WITH p AS (SELECT res_no, raw_text, strpos(raw_text, 'ร้อยละ') - 1 AS pos FROM resolutions WHERE contains(raw_text, 'ร้อยละ')), w AS (SELECT res_no, substring(raw_text, greatest(pos - 300, 0) + 1, 600) AS near FROM p) SELECT res_no, CASE WHEN regexp_matches(near, '(?i)<t[dr]|<table') OR length(near) - length(replace(near, '|', '')) >= 3 THEN 'table' ELSE 'prose' END AS place FROM w")
def share_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first percentage of a text stands in a table."""
    r = table(spark, d, "resolutions").filter(F.contains("raw_text", F.lit("ร้อยละ")))
    return r.select("res_no", tx.context_class(F.col("raw_text"), F.position(F.lit("ร้อยละ"), F.col("raw_text")) - 1).alias("place"))


@query("SELECT res_no, list_reduce(list_prepend(title, list_transform(list_sort(list_transform(list_filter(programs, lambda x: x <> ''), lambda x: struct_pack(n := -length(x), s := x))), lambda z: z.s)), lambda a, x: replace(a, x, '[[' || x || ']]')) AS marked FROM resolutions WHERE title IS NOT NULL AND programs IS NOT NULL")
def marked_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles with their programme tags marked, the longest first."""
    r = table(spark, d, "resolutions").filter("title is not null and programs is not null")
    return r.select("res_no", tx.highlight(F.col("title"), F.filter("programs", lambda x: x != "")).alias("marked"))


@query(f"""WITH p AS ({corpus_tables._PEOPLE('doc_id', 'text', 'documents')}), n AS (SELECT DISTINCT given, surname FROM p), k AS (SELECT a.given AS given, a.surname AS a, b.surname AS b FROM n a JOIN n b ON a.given = b.given AND a.surname < b.surname),
d AS (SELECT *, length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1))) <= 1 AS one_off, least(length(a), length(b)) >= 4 AND (starts_with(a, b) OR starts_with(b, a)) AND least(length(a), length(b)) >= 0.7 * greatest(length(a), length(b)) AS cut FROM k)
SELECT given, a, b, one_off, cut FROM d WHERE one_off OR cut""")
def people_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Surnames of one given name that differ in one character or are cut short: spellings of one person, perhaps."""
    n = stored(table(spark, d, "documents").select(F.explode(dictionaries.people(F.col("text"))).alias("p")).select("p.given", "p.surname").distinct())
    a, b = n.alias("a"), n.alias("b")
    k = a.join(b, (F.col("a.given") == F.col("b.given")) & (F.col("a.surname") < F.col("b.surname"))).select(F.col("a.given").alias("given"), F.col("a.surname").alias("a"), F.col("b.surname").alias("b"))
    both = k.withColumn("one_off", tx.one_char_off(F.col("a"), F.col("b"))).withColumn("cut", tx.prefix_related(F.col("a"), F.col("b")))
    return both.filter("one_off or cut")


@query()
def excised_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the repeats of their loops: cycles of words and runs of lines."""
    out = quality.excised(table(spark, d, "resolutions"), "res_no", "raw_text")
    return out.select("res_no", F.md5("raw_text").alias("text"), "n_cut")
