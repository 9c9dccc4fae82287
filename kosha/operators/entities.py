"""Entity filters, extraction and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def course_codes(text: Column) -> Column:
    """Distinct 8-digit codes followed by a Latin capital; not those after a student's label, which are masked first.

    A run of 8 digits is used up even when its surroundings fail, so no code is found inside a longer run.
    """
    t = F.translate(text, "๐๑๒๓๔๕๖๗๘๙", "0123456789")
    t = F.regexp_replace(t, "((?:รหัสนักศึกษา|รหัสประจำตัวนักศึกษา|student ID|student no\\.)[ :]{0,5})[0-9]{8}", "$1________")
    codes = F.regexp_extract_all(t, F.lit("[0-9]{8}"), F.lit(0))
    after = F.regexp_extract_all(t, F.lit("[0-9]{8}(?=((?s:.{0,5})))"), F.lit(1))
    kept = F.filter(F.arrays_zip(codes.alias("code"), after.alias("after")), lambda z: F.rlike(z["after"], F.lit(r"\A\s*[A-Z]")))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda z: z["code"])))


def metadata_filter(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows equal in every field; None matches null."""
    for k, v in wanted.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df


def entity_filter(wanted: dict[str, list[str]]) -> Column:
    """Any of the names within a kind, all kinds; null tags match nothing. Names of a query are a handful."""
    hit = F.lit(True)
    for kind, names in wanted.items():
        hit = hit & F.coalesce(F.arrays_overlap(F.col(kind), F.array(*map(F.lit, names))), F.lit(False))
    return hit


def first_chunks(chunks: DataFrame, doc: str, index: str) -> DataFrame:
    """The first chunk of each document."""
    return chunks.withColumn("r", F.row_number().over(Window.partitionBy(doc).orderBy(index))).filter("r = 1").drop("r")


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, most: float, value: str) -> DataFrame:
    """For each left row the last right row of the same keys at or before it and at most so far away (an as-of join).

    Both sides are one time line per key: a running last value, so no pairs are formed.
    """
    cols = [c for c in left.columns]
    line = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_at", F.lit(None).cast(right.schema[at].dataType)).withColumn("_side", F.lit(1))
    other = right.select(*keys, at, F.col(value).alias("_v"), F.col(at).alias("_at")).withColumn("_side", F.lit(0))
    both = line.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side", F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_at", "_v")), True).over(w)).filter("_side = 1")
    near = (F.col(at).cast("double") - F.col("_last._at").cast("double")) <= most
    return last.select(*cols, F.when(near, F.col("_last._v")).alias(f"near_{value}"))


def votes(pairs: DataFrame, key: str, value: str, share: float = 0.6, least: int = 2) -> DataFrame:
    """key, value (most votes, least on ties), votes, total, share, status: resolved, ambiguous or no_evidence."""
    n = pairs.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("votes"))
    total = n.withColumn("total", F.sum("votes").over(Window.partitionBy(key))).withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("votes").desc(), value)))
    top = total.filter("r = 1").select(key, value, "votes", "total", F.round(F.col("votes") / F.col("total"), 6).alias("share"))
    every = pairs.select(key).distinct().join(top, key, "left")
    return every.withColumn("status", F.when(F.col("votes").isNull(), "no_evidence").when((F.col("share") >= share) & (F.col("votes") >= least), "resolved").otherwise("ambiguous"))


def last_write(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def kwic(text: Column, needle: Column, reach: int = 40) -> Column:
    """The first occurrence with its surroundings; null without one."""
    at = F.position(needle, text)
    start = F.greatest(at - reach, F.lit(1))
    return F.when((needle != "") & (at > 0), F.substring(text, start, at - start + F.length(needle) + reach))


def citations(answer: Column) -> Column:
    """Distinct numbers in [n], in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def adjunct_title(title: Column, teacher: str = r"อาจารย์[\s​]*พิเศษ", share: str | None = "ร้อยละ") -> Column:
    """Whether a title files adjunct teachers (and, by default, names their share)."""
    hit = title.rlike(teacher)
    return hit if share is None else hit & F.contains(title, F.lit(share))
