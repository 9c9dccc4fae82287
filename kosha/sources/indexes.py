"""Indexes: built once by what they are made of, stored with a manifest as their seal, found in a catalogue, queried in batches."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kosha.operators import chunkers, dense, entities, fusion, lexical
from kosha.operators.loaders import inherited

MANIFEST = "manifest.json"
#: Indexes that stay open at once.
OPEN = 4
#: Columns of a document that its hash covers.
DOCUMENT = ("resolution_id", "raw_text", "year", "session", "title", "source_url", "metadata")

CHUNKERS: dict[str, Callable[[dict], Callable[[Column], Column]]] = {
    "fixed_size": lambda p: lambda t: chunkers.fixed_size(t, p.get("size", 512), p.get("overlap", 0)),
    "sentence": lambda p: lambda t: chunkers.pack(chunkers.merge_short(chunkers.sentences(t)), p.get("size", 512)),
}
EMBEDDERS: dict[str, Callable[[DataFrame, str, str, dict], DataFrame]] = {"hashing": lambda df, key, text, p: dense.hash_vectors(df, key, text, p.get("dim", 512))}


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _text(spark: SparkSession, path: str) -> str | None:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def set_hash(df: DataFrame, columns: list[str]) -> str:
    """16 hex digits for the set of rows, whatever their order; hashed in 4,096 parts first."""
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"c{i}") for i, c in enumerate(columns)])), 256)
    parts = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return whole.first()["h"][:16]


def cache_key(docs: DataFrame, chunker: dict, embedder: dict) -> str:
    """What an index is made of: its documents with all their fields, the chunker and the embedder."""
    import hashlib

    made = json.dumps({"docs": set_hash(docs, [c for c in DOCUMENT if c in docs.columns]), "chunker": chunker, "embedder": embedder}, sort_keys=True)
    return hashlib.sha256(made.encode()).hexdigest()[:16]


def require_unique(docs: DataFrame, key: str = "resolution_id", path: str = "source_path") -> None:
    """Raises if two files have one id, which would merge their chunks."""
    clashes = docs.groupBy(key).agg(F.count_distinct(path).alias("n")).filter("n > 1").orderBy(key).limit(10).collect()
    if clashes:
        raise ValueError("ids of several files: " + ", ".join(repr(r[0]) for r in clashes))


@dataclass
class Index:
    path: str
    chunks: DataFrame
    postings: DataFrame
    manifest: dict


def _parts(made: dict, known: dict, what: str):
    if made.get("type") not in known:
        raise KeyError(f"unknown {what} {made.get('type')!r}, not one of {sorted(known)}")
    return known[made["type"]]


def build(docs: DataFrame, root: str, chunker: dict, embedder: dict) -> Index:
    """The index of these documents, below root: loaded if it was built before, else chunked, embedded, weighted and sealed.

    Chunks take over the document's year, session and metadata; a chunk's own page wins. docs: resolution_id, raw_text, source_path
    and, where there, year, session, title, source_url, metadata (JSON). Documents without text have no chunks.
    """
    spark = docs.sparkSession
    cut, embed = _parts(chunker, CHUNKERS, "chunker")(chunker), _parts(embedder, EMBEDDERS, "embedder")
    if "source_path" in docs.columns:
        require_unique(docs)
    path = f"{root.rstrip('/')}/{cache_key(docs, chunker, embedder)}"
    if _text(spark, f"{path}/{MANIFEST}") is not None:
        return load(spark, path)
    began = time.time()
    keep = tuple(c for c in ("year", "session", "metadata") if c in docs.columns)
    rows = chunkers.chunk_rows(docs, "resolution_id", "raw_text", cut, keep).withColumn("chunk_id", F.concat_ws(":", "resolution_id", "chunk_index"))
    own = F.create_map(F.lit("page"), F.col("page").cast("string"))
    parent = F.from_json("metadata", "map<string,string>") if "metadata" in keep else F.create_map().cast("map<string,string>")
    fields = [x for c in keep if c != "metadata" for x in (F.lit(c), F.col(c))]
    both = inherited(parent, F.create_map(*fields)) if fields else parent
    rows = rows.select("chunk_id", "resolution_id", "chunk_index", "page", F.col("chunk").alias("text"), inherited(both, own).alias("metadata"))
    rows.write.mode("overwrite").parquet(f"{path}/text")
    text = spark.read.parquet(f"{path}/text")
    embed(text, "chunk_id", "text", embedder).withColumnRenamed("v", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    lexical.weighted_postings(text, "chunk_id", "text").repartitionByRange("term", "chunk_id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    manifest = {"chunker": chunker, "embedder": embedder, "n_docs": docs.count(), "n_chunks": text.count(), "docset": set_hash(docs, ["resolution_id"]), "ids": set_hash(text, ["chunk_id"]), "seconds": round(time.time() - began, 3), "stamp": time.time_ns()}
    _write(spark, f"{path}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False))
    return load(spark, path)


_OPEN: OrderedDict[tuple[str, str], Index] = OrderedDict()


def load(spark: SparkSession, path: str) -> Index:
    """An index, refused unless it is sealed. The last OPEN ones stay open; one that was built anew since is opened again. Vectors are a table of their own, read only where they are asked for."""
    sealed = _text(spark, f"{path}/{MANIFEST}")
    if sealed is None:
        raise FileNotFoundError(f"{path} has no {MANIFEST}: it is half written or no index")
    key, manifest = (spark.sparkContext.applicationId, path), json.loads(sealed)
    held = _OPEN.pop(key, None)
    if held is None or held.manifest["stamp"] != manifest["stamp"]:
        held = Index(path, spark.read.parquet(f"{path}/text"), spark.read.parquet(f"{path}/postings"), manifest)
    _OPEN[key] = held
    while len(_OPEN) > OPEN:
        _OPEN.popitem(last=False)
    return held


def catalogue(spark: SparkSession, root: str) -> list[tuple[str, dict]]:
    """(path, manifest) of the sealed indexes below root, by path."""
    fs, p = _file(spark, root)
    found = sorted(f"{root.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(p)) if fs.exists(p) else []
    return [(x, json.loads(t)) for x in found if (t := _text(spark, f"{x}/{MANIFEST}")) is not None]


def resolve(known: list[tuple[str, dict]], chunker: str, embedder: str, dim: int | None = None) -> str:
    """The path of the one index made so; dim None takes any. None or several is an error."""
    hits = [p for p, m in known if m["chunker"]["type"] == chunker and m["embedder"]["type"] == embedder and dim in (None, m["embedder"].get("dim"))]
    if len(hits) != 1:
        raise LookupError(f"{len(hits)} indexes of {chunker} and {embedder}")
    return hits[0]


#: Retrievers whose rows come from a store of their own, to which a filter in this process can't be applied.
EXTERNAL = ("served",)
#: Depth at which the arms of a served index are fused.
SERVED_DEPTH = 200


def guard(how: str, columns: list[str], wanted: dict[str, list[str]] | None) -> None:
    """Raises where a filter can't work: an external store, or tags that the chunks don't have."""
    if wanted and how in EXTERNAL:
        raise ValueError(f"{how} can't be filtered here")
    missing = sorted(set(wanted or ()) - set(columns))
    if missing:
        raise ValueError(f"no tags {missing}: load the documents with their entities first")


def retrieve(index: Index, queries: DataFrame, how: str = "hybrid", k: int = 10, wanted: dict[str, list[str]] | None = None, tags: DataFrame | None = None, depth: int = 50) -> DataFrame:
    """query_id, chunk_id, score, rank of a batch of queries (query_id, query) by bm25, dense, hybrid or entity_lookup.

    wanted filters the documents by their tags (resolution_id and arrays) before the ranking; word statistics are then those of the
    filtered chunks. entity_lookup gives the first chunk of every document that matches, whatever k, and nothing without a filter.
    """
    guard(how, tags.columns if tags is not None else [], wanted)
    if how == "served":
        # the stored arms alone, deep, of an index that says what it is made of
        if not {"docset", "ids", "embedder"} <= set(index.manifest):
            raise ValueError(f"{index.path} does not say what it is made of")
        return retrieve(index, queries, "hybrid", k, depth=max(SERVED_DEPTH, k))
    spark, chunks = queries.sparkSession, index.chunks
    if wanted:
        chunks = chunks.join(tags.filter(entities.entity_filter(wanted)).select("resolution_id"), "resolution_id", "left_semi")
    if how == "entity_lookup":
        first = entities.first_chunks((chunks if wanted else chunks.limit(0)).withColumn("o", F.struct("chunk_index", "chunk_id")), "resolution_id", "o")
        one = first.select("chunk_id", F.lit(1.0).alias("score"), "resolution_id")
        from pyspark.sql.window import Window

        ids = queries.select("query_id").distinct().agg(F.collect_list("query_id").alias("q"))  # a batch of queries is bounded
        each = one.join(F.broadcast(ids)).select(F.explode("q").alias("query_id"), "chunk_id", "score", "resolution_id")
        return each.select("query_id", "chunk_id", "score", F.row_number().over(Window.partitionBy("query_id").orderBy("resolution_id")).alias("rank"))
    fetched = k if how in ("bm25", "dense") else max(k, depth)
    arms = {}
    if how in ("bm25", "hybrid"):
        postings = lexical.weighted_postings(chunks, "chunk_id", "text") if wanted else index.postings
        arms["bm25"] = lexical.bm25(queries, "query_id", "query", postings, "chunk_id", fetched, chunks)
    if how in ("dense", "hybrid"):
        vectors = spark.read.parquet(f"{index.path}/vectors").withColumnRenamed("vector", "v")
        if wanted:
            vectors = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        asked = queries.select(F.concat(F.lit("q:"), F.col("query_id").cast("string")).alias("chunk_id"), F.col("query").alias("text"))
        made = index.manifest["embedder"]
        got = dense.cosine_top_k(_parts(made, EMBEDDERS, "embedder")(asked, "chunk_id", "text", made), vectors, "chunk_id", "v", fetched)
        arms["dense"] = got.select(F.substring("query_key", 3, 20).cast(queries.schema["query_id"].dataType).alias("query_id"), "chunk_id", "score", "rank")
    if how == "hybrid":
        return fusion.ranked(fusion.rrf(fusion.both(arms["dense"], arms["bm25"], "query_id", "chunk_id", fetched)), "query_id", "chunk_id", k).select("query_id", "chunk_id", "score", "rank")
    if how not in arms:
        raise KeyError(f"unknown retriever {how!r}")
    return arms[how]


def compare(indexes: dict[str, Index], queries: DataFrame, how: str = "hybrid", k: int = 10) -> DataFrame:
    """index_name and the ranking of each index, side by side; an empty dict gives an error."""
    if not indexes:
        raise ValueError("no indexes to compare")
    out = None
    for name, index in indexes.items():
        own = retrieve(index, queries, how, k).select(F.lit(name).alias("index_name"), "query_id", "chunk_id", "score", "rank")
        out = own if out is None else out.union(own)
    return out


def routed(spark: SparkSession, root: str, queries: DataFrame, targets: dict[str, dict], how: str = "hybrid", k: int = 10) -> DataFrame:
    """Each query by the index its route asks for (queries: query_id, query, route); a route without a target is answered by all of them, merged by documents' reciprocal ranks.

    route, query_id, resolution_id, score, rank. targets: the arguments of resolve() by route.
    """
    known, out = catalogue(spark, root), None
    opened = {r: load(spark, resolve(known, **t)) for r, t in targets.items()}
    for r in [row[0] for row in queries.select("route").distinct().collect()]:
        own = queries.filter(F.col("route") == r)
        used = {r: opened[r]} if r in opened else {p: load(spark, p) for p, _ in known}
        hits = None
        for arm, index in enumerate(used.values()):
            got = retrieve(index, own, how, k).join(index.chunks.select("chunk_id", "resolution_id"), "chunk_id").withColumn("arm", F.lit(arm))
            hits = got if hits is None else hits.unionByName(got)
        ranked = fusion.merge_documents(hits, "query_id", "resolution_id", "arm", k).select(F.lit(r).alias("route"), "query_id", "resolution_id", "score", "rank")
        out = ranked if out is None else out.union(ranked)
    return out


def warm(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Opens indexes and reads their manifests; the failures by path, none of which stops the others."""
    failed = {}
    for p in paths:
        try:
            load(spark, p).chunks.limit(1).collect()
        except Exception as e:  # kept apart by path
            failed[p] = f"{type(e).__name__}: {e}"
    return failed
