"""Resumable ingestion of new readings, as a stream over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "staging_no bigint, pdf string, page bigint, files array<string>, new_text string, staged_at timestamp_ntz"


def new_readings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of arriving files, as they come; append_once() leaves out what was there before, however late it comes again."""
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("day", F.to_date("staged_at"))


def append_once(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch without repeated rows and without the keys that the target already holds; a batch run again adds nothing.

    The target is partitioned by the day of staging. A reading given again has its day, so only the days of a batch are read of
    the target, however large it is. Late rows are kept, into the day they belong to.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["staging_no"])
        if _exists(spark, target):
            days = once.select("day").distinct()
            known = spark.read.schema(f"{SCHEMA}, day date").parquet(target).join(F.broadcast(days.withColumnRenamed("day", "d")), F.col("day").eqNullSafe(F.col("d")), "left_semi")  # a batch has few days
            once = once.join(known.select("staging_no"), "staging_no", "left_anti")
        once.write.mode("append").partitionBy("day").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def hourly_counts(spark: SparkSession, path: str, late: str = "2 hours") -> DataFrame:
    """Readings by hour of staging, with late rows up to the watermark."""
    rows = spark.readStream.schema(SCHEMA).parquet(path).withColumn("at", F.col("staged_at").cast("timestamp"))
    return rows.withWatermark("at", late).groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.approx_count_distinct("pdf").alias("pdfs"))
