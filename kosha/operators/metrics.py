"""Ranking metrics over flat rankings (combination_id, query_id, rank, resolution_id, …) and judgements (query_id, resolution_id).

The window k is over chunks; documents are made distinct afterwards. Every judged query counts for every
combination; a missing ranking scores 0. A query without judgements scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.session import literal_rows

KEYS = ("combination_id", "query_id")


def cleaned(rankings: DataFrame) -> DataFrame:
    """One row per combination, query and rank; of repeated rows the first by chunk."""
    return rankings.groupBy(*KEYS, "rank").agg(F.min_by(F.struct("chunk_id", "resolution_id", "page", "score", "retriever", "run_at"), F.struct(F.col("chunk_id"), F.col("resolution_id"), F.col("score"))).alias("r")).select(*KEYS, "rank", "r.*")


def judged(qrels: DataFrame) -> DataFrame:
    return qrels.filter(F.col("resolution_id").isNotNull()).select("query_id", "resolution_id").distinct()


def first_hits(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """combination_id, query_id, resolution_id, rank: the first rank of each relevant document, and hit_no by rank."""
    best = rankings.join(judged(qrels), ["query_id", "resolution_id"]).groupBy(*KEYS, "resolution_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("hit_no", F.row_number().over(Window.partitionBy(*KEYS).orderBy("rank", "resolution_id")))


def per_query(rankings: DataFrame, qrels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """combination_id, query_id, n_rel, rr and, for each k, recall, precision, ap and ndcg."""
    hits = first_hits(rankings, qrels)
    aggs = [F.min("rank").alias("first")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.count_if(inside).alias(f"hits_{k}"), F.sum(F.when(inside, F.col("hit_no") / F.col("rank")).otherwise(0.0)).alias(f"ap_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}")]
    found = hits.groupBy(*KEYS).agg(*aggs)
    rel = judged(qrels).groupBy("query_id").agg(F.count("*").alias("n_rel"))
    # every judged query for every combination: the judged queries are a hand-made list, the combinations a table that grows
    grid = rankings.select("combination_id").distinct().select("combination_id", F.explode(literal_rows(rel)).alias("q")).select("combination_id", "q.*")
    out = grid.join(found, list(KEYS), "left")
    cols = [F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr")]
    for k in ks:
        n = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        cols += [F.round(n / F.col("n_rel"), 6).alias(f"recall_{k}"), F.round(n / F.lit(k), 6).alias(f"precision_{k}"), F.round(F.coalesce(F.col(f"ap_{k}"), F.lit(0.0)) / F.col("n_rel"), 6).alias(f"ap_{k}"), F.round(F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal, 6).alias(f"ndcg_{k}")]
    return out.select("combination_id", "query_id", "n_rel", *cols)


def evaluate(scores: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """combination_id and the mean of each metric; MAP at the greatest k."""
    names = ["rr", *(f"{m}_{k}" for k in ks for m in ("recall", "precision", "ndcg")), f"ap_{max(ks)}"]
    return scores.groupBy("combination_id").agg(*[F.round(F.avg(n), 5).alias(n) for n in names])


def argmax(means: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """The key with the greatest value in each group, the least key on ties."""
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), key) if group else Window.orderBy(F.col(value).desc(), key)
    return means.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def leave_one_out(scores: DataFrame, item: str, key: str, value: str) -> DataFrame:
    """For each item the key that is best on the mean of all other items, and its value on the item."""
    w = Window.partitionBy(key)
    others = scores.withColumn("others", F.round(F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1), 6))
    best = others.withColumn("r", F.row_number().over(Window.partitionBy(item).orderBy(F.col("others").desc_nulls_last(), key)))
    return best.filter("r = 1").select(item, key, value, "others")


def contexts(rankings: DataFrame, judgements: DataFrame, text: str, k: int, chars: int) -> DataFrame:
    """combination_id, query_id, label, resolution_id, t, is_gold, context_has_gold: the first k documents' hits as blocks.

    A ranking is read in order up to the first hit of document k + 1, so later hits of the documents before it are
    not part of a block. A block is its hits' texts, by line breaks, cut to so many characters; a null text counts as empty.
    """
    own = Window.partitionBy(*KEYS)
    first = rankings.filter(F.col("resolution_id").isNotNull()).withColumn("fr", F.min("rank").over(Window.partitionBy(*KEYS, "resolution_id")))
    seen = first.withColumn("label", F.dense_rank().over(own.orderBy("fr"))).withColumn("end", F.min(F.when(F.col("label") == k + 1, F.col("rank"))).over(own))
    kept = seen.filter((F.col("label") <= k) & (F.col("end").isNull() | (F.col("rank") < F.col("end"))))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.col(text), F.lit("")).alias("x")))), lambda z: z["x"])
    blocks = kept.groupBy(*KEYS, "label", "resolution_id").agg(F.substring(F.array_join(texts, "\n"), 1, chars).alias("t"))
    gold = blocks.join(judgements.withColumn("g", F.lit(True)), ["query_id", "resolution_id"], "left").withColumn("is_gold", F.coalesce("g", F.lit(False)))
    return gold.withColumn("context_has_gold", F.max("is_gold").over(own)).drop("g")


def depth_band(rank: Column) -> Column:
    return F.when(rank.isNull(), "none").when(rank <= 10, "1-10").when(rank <= 50, "11-50").when(rank <= 100, "51-100").when(rank <= 1000, "101-1000").otherwise("1001+")
