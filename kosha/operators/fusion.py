"""Fusion of rankings. An arm is a DataFrame of qkey, key, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF = 60


def both(dense: DataFrame, lexical: DataFrame, q: str, k: str, depth: int | None = None) -> DataFrame:
    """Full outer join of two arms, each cut at depth first; what is cut contributes nothing."""
    cut = lambda a, n: (a if depth is None else a.filter(F.col("rank") <= depth)).select(q, k, F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank"))
    return cut(dense, "d").join(cut(lexical, "l"), [q, k], "full")


def ranked(df: DataFrame, q: str, k: str, top: int) -> DataFrame:
    """By score; ties keep the dense order, then the lexical one."""
    w = Window.partitionBy(q).orderBy(F.col("score").desc(), F.col("d_rank").asc_nulls_last(), F.col("l_rank").asc_nulls_last(), k)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def rrf(joined: DataFrame, alpha: Column | float = 0.5) -> DataFrame:
    """Reciprocal ranks: alpha for the dense arm, the rest for the lexical one."""
    part = lambda w, r: F.coalesce(w / (RRF + F.col(r)), F.lit(0.0))
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return joined.withColumn("score", F.round(part(a, "d_rank") + part(1 - a, "l_rank"), 9))


def weighted(joined: DataFrame, q: str, alpha: float = 0.5) -> DataFrame:
    """Scores divided by the arm's greatest of the query (all 0 if that isn't positive); a missing one is 0."""

    def norm(c: str) -> Column:
        most = F.max(c).over(Window.partitionBy(q))
        return F.coalesce(F.when(most > 0, F.col(c) / most).otherwise(0.0), F.lit(0.0))

    return joined.withColumn("score", F.round(alpha * norm("d_score") + (1 - alpha) * norm("l_score"), 6))


def merge_documents(hits: DataFrame, q: str, doc: str, arm: str, top: int) -> DataFrame:
    """Documents by the sum of reciprocal ranks of all their chunks in all arms; first seen (arm, rank) on ties."""
    agg = hits.groupBy(q, doc).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"), F.min(F.struct(arm, "rank")).alias("seen"), F.min("rank").alias("best_rank"))
    w = Window.partitionBy(q).orderBy(F.col("score").desc(), F.col("seen"), F.col(doc))
    return agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("seen")


def partition_first(hits: DataFrame, q: str, hit: Column, pool: int) -> DataFrame:
    """Within the first pool ranks those that hit come first, in their order; the tail stays; ranks anew."""
    w = Window.partitionBy(q).orderBy((F.col("rank") <= pool).desc(), F.when(F.col("rank") <= pool, ~hit).otherwise(False), F.col("rank"))
    return hits.withColumn("new_rank", F.row_number().over(w))
