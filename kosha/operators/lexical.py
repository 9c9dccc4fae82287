"""Tokens, postings and BM25 rankings.

An index is materialised once (postings, term weights); a batch of queries then joins its distinct terms.
A term that half of the chunks hold is one key of the join: its postings come pre-weighted, and adaptive
execution splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.session import stored

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; null and blank texts have none."""
    return F.coalesce(F.filter(F.split(F.lower(text), r"[ \n\t]+"), lambda t: t != ""), F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, dl: a row per distinct word of a chunk."""
    own = df.select(key, tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    return own.select(key, "dl", F.explode("ts").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def corpus_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row: n_docs and avgdl, over chunks with and without words."""
    return df.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(posted: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf: a negative idf is replaced by EPSILON times the mean idf over all terms."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    raw = stored(df.withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean")).first()["mean"]
    return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))


def weighted_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, weight: the sparse vectors of the chunks, whose dot product with the query's term counts is BM25."""
    first = corpus_stats(df, key, text).first()
    n, avgdl = first["n_docs"], first["avgdl"] or 1.0
    posted = postings(df, key, text)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return posted.join(term_stats(posted, n), "term").select("term", key, weight.alias("weight"))


def bm25(queries: DataFrame, qkey: str, qtext: str, weighted: DataFrame, key: str, k: int, docs: DataFrame | None = None) -> DataFrame:
    """qkey, key, score, rank of the k best chunks; ties by key.

    With docs (all chunks of the index) every query gets min(k, chunks) rows: chunks that share no term with it score 0 and
    come in the order of their keys. Without, only chunks that share a term are ranked.
    """
    terms = queries.select(qkey, F.explode(tokens(F.col(qtext))).alias("term")).groupBy(qkey, "term").agg(F.count("*").alias("qtf"))
    scored = weighted.join(terms, "term").groupBy(qkey, key).agg(F.round(F.sum(F.col("qtf") * F.col("weight")), 6).alias("score"))
    if docs is None:
        return top_k(scored, qkey, key, k)
    # of a query with fewer than k chunks above 0 as many more are needed; those it has already are among the hits
    scored = stored(scored)
    hits = scored.groupBy(qkey).agg(F.count_if(F.col("score") > 0).alias("above"), F.count("*").alias("n"))
    short = stored(queries.select(qkey).distinct().join(hits, qkey, "left").fillna(0, ["above", "n"]).filter(F.col("above") < k))
    most = short.agg(F.max("n")).first()[0]
    if most is None:
        return top_k(scored, qkey, key, k)
    first = docs.select(key).distinct().orderBy(key).limit(k + most).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    none = short.select(qkey).join(F.broadcast(first)).select(qkey, F.explode("ids").alias(key)).join(scored, [qkey, key], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(scored.unionByName(none), qkey, key, k)


def top_k(scored: DataFrame, qkey: str, key: str, k: int) -> DataFrame:
    """The k best rows of each query with their rank; a partial limit runs before the shuffle."""
    w = Window.partitionBy(qkey).orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
