"""Corpus scans, index and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULTS = T.StructType([T.StructField("combination_id", T.StringType()), T.StructField("query_id", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("resolution_id", T.StringType()), T.StructField("page", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("retriever", T.StringType())])
_PATH = r"([0-9]{4})/ครั้งที่ ([0-9]+s?)/([^/]+)\.md$"


def is_resolution_path(path: Column) -> Column:
    """year/ครั้งที่ session/file.md; copies marked .dup are none."""
    return F.coalesce(path.rlike(_PATH) & ~path.contains(".dup"), F.lit(False))


def path_fields(path: Column) -> Column:
    """struct<year,session,stem>; null where the path has none."""
    part = lambda i: F.nullif(F.regexp_extract(path, _PATH, i), F.lit(""))
    return F.struct(part(1).alias("year"), part(2).alias("session"), part(3).alias("stem"))


def read_corpus(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """source_path, raw_text, year, session, title of the Markdown files below root; limit only for a development subset.

    A meeting's manifest.json (a list of file, title, url) overrides the title; a missing or broken one is
    empty. A link stands in the manifest, else in the file's own _LINK.txt. A byte order mark is dropped. Files of no bytes are skipped by the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    own = files.withColumn("source_path", F.url_decode(F.regexp_replace("path", r"\+", "%2B")))
    own = own.filter(is_resolution_path(F.col("source_path")))
    if limit is not None:
        own = own.orderBy("source_path").limit(limit)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\A﻿", "")
    docs = own.select("source_path", text.alias("raw_text"), path_fields(F.col("source_path")).alias("p")).select("source_path", "raw_text", "p.*")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(root)
    listed = F.from_json(F.decode("content", "UTF-8"), "array<struct<file:string,title:string,url:string>>", {"mode": "PERMISSIVE"})
    names = found.select(F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([0-9]{4}/ครั้งที่ [0-9]+s?)/manifest.json$", 1).alias("meeting"), F.explode(listed).alias("m")).select("meeting", "m.*").groupBy("meeting", "file").agg(F.min("title").alias("listed"), F.min("url").alias("source_url"))
    keyed = docs.withColumn("meeting", F.concat("year", F.lit("/ครั้งที่ "), "session")).withColumn("file", F.concat("stem", F.lit(".md")))
    links = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_LINK.txt").load(root)
    links = links.select(F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([0-9]{4}/ครั้งที่ [0-9]+s?)/(?:.+)_LINK.txt$", 1).alias("meeting"), F.concat(F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]+)_LINK.txt$", 1), F.lit(".md")).alias("file"), F.trim(F.regexp_replace(F.decode("content", "UTF-8"), r"\A\uFEFF|\s+\z", "")).alias("link"))
    return keyed.join(names, ["meeting", "file"], "left").join(links, ["meeting", "file"], "left").select("source_path", "raw_text", F.coalesce("source_url", "link").alias("source_url"), "year", "session", F.coalesce("listed", "stem").alias("title"))


def save_index(chunks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Chunks with their vectors and tokens as one table; Spark's commit (_SUCCESS, written last) seals it."""
    out = chunks if buckets is None else chunks.repartition(buckets, "chunk_id")
    out.write.mode("errorifexists").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Refuses an index that isn't sealed; unused columns are pruned by the scan."""
    jvm = spark._jvm
    seal = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not seal.getFileSystem(spark._jsc.hadoopConfiguration()).exists(seal):
        raise FileNotFoundError(f"{path} has no seal: it is half written or no index")
    return spark.read.parquet(path)


def save_results(rankings: DataFrame, path: str) -> None:
    """Flat rankings by combination, so that one combination is read alone."""
    rankings.write.mode("overwrite").partitionBy("combination_id").parquet(path)


def results_json(rankings: DataFrame) -> DataFrame:
    """One JSON document per combination and query, results by rank; file_name holds the first 8 hex digits of the query's hash."""
    hit = F.struct("rank", "chunk_id", "resolution_id", "page", "score")
    nested = rankings.groupBy("combination_id", "query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))
    name = F.concat("combination_id", F.lit("__"), F.substring(F.sha2(F.col("query_id").cast("string"), 256), 1, 8), F.lit(".json"))
    return nested.select("combination_id", "query_id", name.alias("file_name"), F.to_json(F.struct("query_id", "combination_id", "results", F.size("results").alias("top_k"))).alias("body"))


def docset_hash(df: DataFrame, group: str, key: str) -> DataFrame:
    """group, n, docset: a hash of the set of keys. Keys are hashed in parts, then the parts in order, so that no group is one task."""
    part = F.substring(F.md5(key), 1, 3)
    each = df.groupBy(group, part.alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("h"))
    return each.groupBy(group).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "h"))).alias("hs")).select(group, "n", F.substring(F.sha2(F.array_join("hs.h", ""), 256), 1, 16).alias("docset"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a number from 0 in the order of a column of distinct values: ranges are sorted on their own, each moved by the sizes of those before."""
    from pyspark.sql.window import Window

    from kosha.session import stored

    parts = stored(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, entity_type, entity, resolution_id: a hand-made list of queries with their relevant ids, JSON or YAML, numbered in order; a row per id, one without an id where there is none."""
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith((".yaml", ".yml")):
        import yaml

        listed = yaml.safe_load(text)
    else:
        import json

        listed = json.loads(text)
    rows = [(i, x["query"], x.get("entity_type"), x.get("entity"), r) for i, x in enumerate(listed or ()) for r in x.get("relevant_resolution_ids") or [None]]
    return spark.createDataFrame(rows, "query_id int, query string, entity_type string, entity string, resolution_id string")


def save_vector_documents(docs: DataFrame, path: str, key: str, vectors: str) -> None:
    """Documents of several vectors as a column of nested arrays; refused if one is empty or of mixed sizes."""
    bad = docs.filter((F.coalesce(F.size(vectors), F.lit(0)) <= 0) | (F.size(F.array_distinct(F.transform(vectors, lambda v: F.size(v)))) > 1)).select(key).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]!r} has no vectors, or vectors of several sizes")
    docs.select(key, vectors).write.mode("errorifexists").parquet(path)
