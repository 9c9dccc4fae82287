"""Text functions and chunkers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kosha.functions import text as tx
from kosha.operators import chunkers as ch
from kosha.operators import dense, quality
from kosha.operators.lexical import tokens
from kosha.plans.registry import query
from kosha.session import table

_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[ \n\t]+'), lambda t: t <> '')"
_WS = r"trim(regexp_replace({0}, '[ \t\n\r]+', ' ', 'g'), ' ')"
_DIGITS = "translate({0}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"


@query(r"""
SELECT res_no, regexp_replace(CASE WHEN h = '' THEN raw_text ELSE substring(raw_text, 1, strpos(raw_text, h) - 1) || substring(raw_text, strpos(raw_text, h) + length(h)) END, '\A\n+', '') AS body
FROM (SELECT res_no, raw_text, regexp_extract(raw_text, '(?m)^[ \t]*#[ \t]*Document:.*$') AS h FROM resolutions)""")
def header_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").select("res_no", tx.strip_document_header(F.col("raw_text")).alias("body"))


@query(r"""
SELECT res_no, regexp_replace(regexp_replace(regexp_replace(translate(raw_text, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS body FROM resolutions""")
def thai_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").select("res_no", tx.normalize_thai(F.col("raw_text")).alias("body"))


@query(f"SELECT doc_id, {_WS.format('text')} AS text_ws, strlen(text) AS token_bound FROM documents")
def ws_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.collapse_ws(F.col("text")).alias("text_ws"), F.octet_length("text").cast("bigint").alias("token_bound"))


_AGENDA = tx.AGENDA
_SUBJECT = r"substring(coalesce(regexp_replace(nullif(regexp_extract(" + _WS.format("substring(raw_text, 1, 4000)") + f", '{tx.HEADING}', 1), ''), '{_AGENDA}', ''), trim(regexp_extract(substring(raw_text, 1, 4000), '(?m)^[ ]*([^ #<\n][^\n]*)$', 1))), 1, 300)"


@query(rf"""
SELECT res_no, coalesce(nullif(regexp_extract(source_url, '/(?:d/|item/|[0-9]{{4}}/)([A-Za-z0-9_-]+)$', 1), ''), trim(source_url)) AS link, regexp_replace(title, '{_AGENDA}', '') AS subject, {_SUBJECT} AS first_line FROM resolutions""")
def link_and_subject(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").select("res_no", tx.link_key(F.col("source_url")).alias("link"), tx.strip_agenda(F.col("title")).alias("subject"), tx.subject_line(F.col("raw_text")).alias("first_line"))


@query(rf"""
SELECT res_no, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: contains(s, x)))::DOUBLE / len(w) END, 6) AS coverage
FROM (SELECT res_no, list_filter(string_split({_WS.format(f"regexp_replace(title, '{_AGENDA}', '')")}, ' '), lambda x: length(x) >= 2 AND NOT list_contains({list(tx.EMPTY_WORDS)!r}, x) AND NOT regexp_full_match(x, '[0-9๐-๙]+') AND regexp_matches(x, '[0-9A-Za-zก-๛À-\x{{FFFF}}]')) AS w, replace(coalesce({_SUBJECT}, ''), ' ', '') AS s FROM resolutions WHERE title IS NOT NULL)""")
def title_body_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How much of each title the subject line of its text supports; the subject stands in the first 4,000 characters by definition."""
    r = table(spark, d, "resolutions").filter("title is not null")
    return r.select("res_no", F.round(tx.coverage(F.col("title"), tx.subject_line(F.col("raw_text"))), 6).alias("coverage"))


@query(r"""
SELECT tbl, sig, count(*) AS n FROM (SELECT 'page_results' AS tbl, """ + _WS.format("regexp_replace(" + _DIGITS.format("line") + ", '[0-9]', '0', 'g')") + r""" AS sig FROM (SELECT unnest(string_split(new_text, chr(10))) AS line FROM page_results WHERE new_text IS NOT NULL)) GROUP BY ALL""")
def row_signatures(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "page_results").select(F.explode(F.split("new_text", "\n")).alias("line"))
    return lines.groupBy(F.lit("page_results").alias("tbl"), tx.row_signature(F.col("line")).alias("sig")).agg(F.count("*").alias("n"))


@query(r"""
SELECT staging_no, bool_or(CASE WHEN t IS NULL THEN true WHEN length(t) < 5 THEN true ELSE 2 * m > length(t) END) AS bad
FROM (SELECT staging_no, t, list_max(list_transform(list_distinct(string_split(t, '')), lambda c: length(t) - length(replace(t, c, '')))) AS m FROM (SELECT staging_no, trim(new_text) AS t FROM page_results)) GROUP BY 1""")
def bad_recognition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_results").groupBy("staging_no").agg(F.bool_or(tx.is_bad_output(F.col("new_text"))).alias("bad"))


@query(r"""
SELECT DISTINCT resolution_id, coalesce(try_cast(nullif(regexp_extract(resolution_id, '\A([0-9]{4})/([0-9]+)', 1), '') AS INT), 9999) AS year, coalesce(try_cast(nullif(regexp_extract(resolution_id, '\A([0-9]{4})/([0-9]+)', 2), '') AS INT), 9999) AS session, string_split(resolution_id, ' — ')[1] AS event FROM resolutions""")
def meeting_keys(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolutions").select("resolution_id").distinct()
    return r.select("resolution_id", tx.meeting_key(F.col("resolution_id")).alias("m"), tx.event_key(F.col("resolution_id")).alias("event")).select("resolution_id", "m.year", "m.session", "event")


@query(r"""
SELECT res_no, len(list_filter(regexp_extract_all(raw_text, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(title, '[0-9]+'), x))) AS novel FROM resolutions WHERE title IS NOT NULL""")
def novel_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").filter("title is not null").select("res_no", tx.novel_numbers(F.col("raw_text"), F.col("title")).cast("bigint").alias("novel"))


@query(r"""
SELECT a.faculty_id AS a, b.faculty_id AS b, len(list_filter(range(1, length(a.canonical) + 1), lambda i: substring(a.canonical, i, 1) <> substring(b.canonical, i, 1))) <= 1 AS one_off
FROM faculties a JOIN faculties b ON a.prefix_type = b.prefix_type AND length(a.canonical) = length(b.canonical) AND a.faculty_id < b.faculty_id""")
def spelling_blocks(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "faculties").withColumn("n", F.length("canonical"))
    a, b = f.alias("a"), f.alias("b")
    both = a.join(b, (F.col("a.prefix_type") == F.col("b.prefix_type")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.faculty_id") < F.col("b.faculty_id")))
    return both.select(F.col("a.faculty_id").alias("a"), F.col("b.faculty_id").alias("b"), tx.one_char_off(F.col("a.canonical"), F.col("b.canonical")).alias("one_off"))


@query()
def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of one meeting against their own agenda text, by the longest common blocks."""
    r = table(spark, d, "resolutions").filter("title is not null")
    return r.select("res_no", F.round(tx.fuzzy_ratio(F.col("title"), tx.subject_line(F.col("raw_text"))), 6).alias("ratio"), F.length(tx.longest_block(F.col("title"), tx.subject_line(F.col("raw_text")))).alias("longest"))


@query(r"""
WITH p AS (SELECT res_no, unnest(list_transform(string_split(regexp_replace(raw_text, '(?m)^[ \t]*##[ \t]*Page[ \t]+([0-9]+)[ \t]*$', chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda x: x)) AS x, generate_subscripts(string_split(regexp_replace(raw_text, '(?m)^[ \t]*##[ \t]*Page[ \t]+([0-9]+)[ \t]*$', chr(1) || '\1' || chr(2), 'g'), chr(1)), 1) AS i FROM resolutions),
q AS (SELECT res_no, i, CASE WHEN contains(x, chr(2)) THEN string_split(x, chr(2))[1]::INT ELSE 1 END AS page, trim(string_split(x, chr(2))[-1], ' ' || chr(10) || chr(9)) AS body FROM p)
SELECT res_no, row_number() OVER (PARTITION BY res_no ORDER BY i) - 1 AS pos, page, body FROM q WHERE body <> ''""")
def page_segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").select("res_no", F.posexplode(ch.pages(F.col("raw_text"))).alias("pos", "p")).select("res_no", F.col("pos").cast("bigint").alias("pos"), "p.page", "p.body")


@query("SELECT doc_id, s // 462 AS chunk_index, substring(text, s + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 462)) AS s FROM documents WHERE length(text) > 0)")
def chunk_fixed_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(ch.fixed_size(F.col("text"), 512, 50)).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("""
SELECT source, count(*) AS n, min(l) AS least, max(l) AS most, round(avg(l), 6) AS mean, round(quantile_cont(l::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(l::DOUBLE, 0.9), 6) AS p90, round(avg((l > 500)::INT), 6) AS cut_share
FROM (SELECT source, length(substring(text, s + 1, 512)) AS l FROM (SELECT source, text, unnest(range(0, length(text), 512)) AS s FROM documents WHERE length(text) > 0)) GROUP BY source""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("source", F.explode(ch.fixed_size(F.col("text"), 512, 0)).alias("c")).select("source", F.length("c").alias("l"))
    return c.groupBy("source").agg(F.count("*").alias("n"), F.min("l").cast("bigint").alias("least"), F.max("l").cast("bigint").alias("most"), F.round(F.avg("l"), 6).alias("mean"), F.round(F.percentile("l", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("l", F.lit(0.9)), 6).alias("p90"), F.round(F.avg((F.col("l") > 500).cast("int")), 6).alias("cut_share"))


_PACK = r"""
WITH RECURSIVE g AS (SELECT res_no, i, CASE WHEN contains(x, chr(2)) THEN string_split(x, chr(2))[1]::INT ELSE 1 END AS page, trim(string_split(x, chr(2))[-1], ' ' || chr(10) || chr(9)) AS body FROM (SELECT res_no, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT res_no, string_split(regexp_replace(raw_text, '(?m)^[ \t]*##[ \t]*Page[ \t]+([0-9]+)[ \t]*$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM resolutions))),
u AS (SELECT res_no, i, page, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(body, '([.!?] )', '\1' || chr(3), 'g'), '([。！？।])', '\1' || chr(3), 'g'), '(\n)', '\1' || chr(3), 'g'), chr(3)), lambda t: t <> '') AS l FROM g WHERE body <> ''),
m AS (SELECT res_no, i, page, l, 1 AS pos, ''::VARCHAR AS now, []::VARCHAR[] AS done FROM u
  UNION ALL SELECT res_no, i, page, l, pos + 1, CASE WHEN length(now || l[pos]) >= 15 THEN '' ELSE now || l[pos] END, CASE WHEN length(now || l[pos]) >= 15 THEN list_append(done, now || l[pos]) ELSE done END FROM m WHERE pos <= len(l)),
s AS (SELECT res_no, i, page, CASE WHEN now = '' THEN done WHEN len(done) = 0 THEN [now] ELSE list_append(done[:-2], done[-1] || now) END AS l FROM m WHERE pos = len(l) + 1),
k AS (SELECT res_no, i, page, l, 1 AS pos, ''::VARCHAR AS now, []::VARCHAR[] AS done FROM s
  UNION ALL SELECT res_no, i, page, l, pos + 1, CASE WHEN length(now) + length(l[pos]) <= 512 THEN now || l[pos] ELSE l[pos] END, CASE WHEN length(now) + length(l[pos]) <= 512 OR now = '' THEN done ELSE list_append(done, now) END FROM k WHERE pos <= len(l)),
f AS (SELECT res_no, i, page, CASE WHEN now = '' THEN done ELSE list_append(done, now) END AS l FROM k WHERE pos = len(l) + 1)
SELECT res_no, row_number() OVER (PARTITION BY res_no ORDER BY i, j) - 1 AS chunk_index, page, chunk FROM (SELECT res_no, i, page, unnest(l) AS chunk, generate_subscripts(l, 1) AS j FROM f)"""


@query(_PACK)
def chunk_sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    got = ch.chunk_rows(table(spark, d, "resolutions"), "res_no", "raw_text", lambda t: ch.pack(ch.merge_short(ch.sentences(t)), 512))
    return got.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


_SEMANTIC = _PACK[: _PACK.index(",\nk AS")] + r""",
z AS (SELECT res_no, i, page, unnest(l) AS u, generate_subscripts(l, 1) AS j FROM s),
v AS (SELECT *, list_transform(list_filter(regexp_split_to_array(lower(u), '[ \n\t]+'), lambda t: t <> ''), lambda t: ('0x' || substring(md5(t), 25, 8))::BIGINT % 64) AS b FROM z),
n AS (SELECT *, list_transform(range(0, 64), lambda x: len(list_filter(b, lambda y: y = x))::DOUBLE) AS w FROM v), p AS (SELECT *, lag(w) OVER (PARTITION BY res_no, i ORDER BY j) AS before FROM n),
c AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN list_dot_product(before, w) > 0 AND 4 * list_dot_product(before, w) * list_dot_product(before, w) >= list_dot_product(before, before) * list_dot_product(w, w) THEN 0 ELSE 1 END AS cut FROM p),
gg AS (SELECT *, sum(cut) OVER (PARTITION BY res_no, i ORDER BY j ROWS UNBOUNDED PRECEDING) AS no FROM c)
SELECT res_no, row_number() OVER (PARTITION BY res_no ORDER BY i, no) - 1 AS chunk_index, page, string_agg(u, '' ORDER BY j) AS chunk FROM gg GROUP BY res_no, i, page, no"""


@query(_SEMANTIC)
def chunk_by_meaning(spark: SparkSession, d: str) -> DataFrame:
    got = ch.chunk_rows(table(spark, d, "resolutions"), "res_no", "raw_text", ch.semantic)
    return got.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return ch.python_chunks(table(spark, d, "documents"), "doc_id", "text", "recursive")


_WORDS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+[ \t\n\r\f\v]*') AS l FROM documents WHERE text <> ''),
t AS (SELECT doc_id, n, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS total, length(x) AS size FROM (SELECT doc_id, len(l) AS n, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w)),
c AS (SELECT doc_id, max(n) AS n, list_prepend(0, list(total ORDER BY i))::BIGINT[] AS total FROM t GROUP BY 1),
k AS (SELECT doc_id, n, total, 0 AS no, 0::BIGINT AS first, greatest(1, len(list_filter(total, lambda x: x <= 512)) - 1)::BIGINT AS "end" FROM c
  UNION ALL SELECT doc_id, n, total, no + 1, f, greatest(f + 1, len(list_filter(total, lambda x: x <= total[f + 1] + 512)) - 1)::BIGINT FROM
    (SELECT doc_id, n, total, no, CASE WHEN len(list_filter(total, lambda x: x <= total["end" + 1] - 50)) - 1 <= first THEN "end" ELSE len(list_filter(total, lambda x: x <= total["end" + 1] - 50)) - 1 END::BIGINT AS f FROM k WHERE "end" < n))
SELECT k.doc_id, no AS chunk_index, array_to_string(l[first + 1 : "end"], '') AS chunk FROM k JOIN w USING (doc_id)"""


@query(_WORDS)
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    """Whole words up to 512 characters, going back by whole words until 50 are reached."""
    return ch.python_chunks(table(spark, d, "documents"), "doc_id", "text", "words")


@query("""
WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT label, vec_id, CASE WHEN b IS NULL THEN 0 WHEN coalesce(list_cosine_similarity(e, b), 0) < 0.5 THEN 1 ELSE 0 END AS cut FROM v)
SELECT label, vec_id, sum(cut) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM c""")
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return ch.semantic_groups(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("""
WITH t AS (SELECT doc_id, md5(unnest(""" + _TOKENS.format("text") + """)) AS h FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ('0x' || substring(h, 1, 8))::BIGINT AS a, ('0x' || substring(h, 9, 8))::BIGINT AS b, ('0x' || substring(h, 17, 8))::BIGINT AS c, ('0x' || substring(h, 25, 8))::BIGINT AS e FROM t)
SELECT doc_id, ((((((a % 500) * 296 + b) % 500) * 296 + c) % 500 * 296 + e) % 500)::INT AS bucket, count(*) AS n FROM l GROUP BY ALL""")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return dense.hash_counts(table(spark, d, "documents"), "doc_id", "text", 500)


_ISLAND = """, g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY k ORDER BY pos) THEN 0 ELSE 1 END AS new FROM w))
SELECT k AS res_no, v AS {0}, min(pos) AS "start", max(pos) AS "end", count(*) AS n FROM g GROUP BY k, run, v HAVING {1}"""


@query("WITH w AS (SELECT res_no AS k, i - 1 AS pos, trim(x, ' ' || chr(9) || chr(13)) AS v FROM (SELECT res_no, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM resolutions))" + _ISLAND.format("line", "count(*) >= 4 AND length(v) >= 20"))
def line_repeats(spark: SparkSession, d: str) -> DataFrame:
    got = quality.line_repeats(table(spark, d, "resolutions"), "res_no", "raw_text")
    return got.select("res_no", "line", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "n")


@query(r"WITH s AS (SELECT res_no, list_filter(regexp_split_to_array(regexp_replace(raw_text, '<table[^\n]*</table>', ' ', 'g'), '[ \n\t]+'), lambda t: t <> '') AS l FROM resolutions), w AS (SELECT res_no AS k, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS pos FROM s)" + _ISLAND.format("token", "count(*) >= 3"))
def token_runs(spark: SparkSession, d: str) -> DataFrame:
    got = quality.token_runs(table(spark, d, "resolutions"), "res_no", "raw_text", 3)
    return got.select("res_no", "token", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "n")


@query(r"""
WITH t AS (SELECT res_no, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS table_no FROM (SELECT res_no, regexp_extract_all(""" + _DIGITS.format("raw_text") + r""", '(?is)<table.*?</table>') AS l FROM resolutions)),
w AS (SELECT res_no, table_no, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT res_no, table_no, list_filter(regexp_split_to_array(t, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS l FROM t)),
v AS (SELECT *, try_cast(nullif(regexp_extract(w, '\A([0-9]{1,15})\.\z', 1), '') AS BIGINT) AS v FROM w), c AS (SELECT *, CASE WHEN v = lag(v) OVER o + 1 THEN 0 ELSE 1 END AS cut FROM v WINDOW o AS (PARTITION BY res_no, table_no ORDER BY pos)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY res_no, table_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT res_no, table_no, min(v) AS first, count(*) AS n, min(pos) AS word_no FROM i WHERE v IS NOT NULL GROUP BY res_no, table_no, island HAVING count(*) >= 8""")
def numeric_flood(spark: SparkSession, d: str) -> DataFrame:
    return quality.numeric_flood(table(spark, d, "resolutions"), "res_no", "raw_text").withColumn("table_no", F.col("table_no").cast("bigint"))


@query(r"""
WITH RECURSIVE t AS (SELECT res_no, list_filter(regexp_split_to_array(raw_text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS l FROM resolutions),
e AS (SELECT res_no, len(l) AS n, p, i, l[i] = l[i + p] AS same FROM t, (SELECT unnest(range(2, 9)) AS p), LATERAL (SELECT unnest(range(1, len(l) - p + 1)) AS i)),
g AS (SELECT res_no, n, p, i, i - row_number() OVER (PARTITION BY res_no, p ORDER BY i) AS island FROM e WHERE same),
r AS (SELECT res_no, n, p, min(i) AS a, max(i) AS b FROM g GROUP BY res_no, n, p, island HAVING count(*) >= 5 * p),
-- every place in a run from which at least six cycles are left; the first place, then the least period, then on behind its cycles
c AS (SELECT res_no, p, i, (b - i + 1) // p + 1 AS reps FROM r, LATERAL (SELECT unnest(range(a, b + 1)) AS i) WHERE (b - i + 1) // p + 1 >= 6),
k AS (SELECT c.* FROM c JOIN t USING (res_no) WHERE NOT list_bool_and(list_transform(l[i : i + p - 1], lambda x: regexp_full_match(x, '[-_=|.*#]*')))),
o AS (SELECT *, row_number() OVER (PARTITION BY res_no ORDER BY i, p) AS q FROM k),
s AS (SELECT res_no, i, p, reps FROM o WHERE q = 1 UNION ALL SELECT x.res_no, x.i, x.p, x.reps FROM (SELECT s.res_no, arg_min(struct_pack(i := o.i, p := o.p, reps := o.reps), o.q) AS z FROM s JOIN o ON o.res_no = s.res_no AND o.i >= s.i + s.p * s.reps GROUP BY s.res_no, s.i) y, LATERAL (SELECT y.res_no, y.z.i, y.z.p, y.z.reps) x)
SELECT res_no, (i - 1)::BIGINT AS "start", p::BIGINT AS period, reps::BIGINT AS n FROM s""")
def cyclic_flood(spark: SparkSession, d: str) -> DataFrame:
    got = quality.cyclic_floods(table(spark, d, "resolutions"), "res_no", "raw_text")
    return got.select("res_no", *[F.col(c).cast("bigint").alias(c) for c in ("start", "period", "n")])


@query(r"""
WITH l AS (SELECT res_no, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT res_no, string_split(raw_text, chr(10)) AS l FROM resolutions WHERE raw_text IS NOT NULL)),
n AS (SELECT *, CASE WHEN trim(x, ' ' || chr(9) || chr(13)) = lag(trim(x, ' ' || chr(9) || chr(13))) OVER (PARTITION BY res_no ORDER BY i) THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY res_no ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
r AS (SELECT *, count(*) OVER (PARTITION BY res_no, run) AS times, row_number() OVER (PARTITION BY res_no, run ORDER BY i) AS nth, length(first(trim(x, ' ' || chr(9) || chr(13))) OVER (PARTITION BY res_no, run)) AS size FROM g)
SELECT res_no, string_agg(x, chr(10) ORDER BY i) AS raw_text FROM r WHERE nth = 1 OR times < 4 OR size < 20 GROUP BY 1 UNION ALL SELECT res_no, NULL FROM resolutions WHERE raw_text IS NULL""")
def loop_excision(spark: SparkSession, d: str) -> DataFrame:
    return quality.without_line_loops(table(spark, d, "resolutions"), "res_no", "raw_text")


@query("""
SELECT sha256(text) AS hash, count(*) AS n, count(DISTINCT source) AS n_groups, min(doc_id) AS "first", CASE WHEN count(DISTINCT source) > 1 THEN 'across' ELSE 'within' END AS kind FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicates(table(spark, d, "documents"), "doc_id", "text", "source")


@query(f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, coalesce({_TOKENS.format('text')}, []) AS t FROM documents)""")
def tokenize_tf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))
