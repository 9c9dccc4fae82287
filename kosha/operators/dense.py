"""Vector rankings: exact cosine, hashed bags of words, late interaction."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kosha.session import ship, stored

from .lexical import tokens, top_k

#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Scores in one matrix product of a worker.
MATRIX = 4_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero, so its cosine is 0 and never undefined."""
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def best(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each column of a (rows, columns) matrix, ties by key; a selection first, so that only some k rows of each column are sorted."""
    n = len(score)
    if n <= k:
        row, col = np.indices(score.shape)
        return row.ravel(), col.ravel()
    least = np.partition(score, n - k, axis=0)[n - k]
    row, col = np.nonzero(score >= least)
    order = np.lexsort((keys[row], -score[row, col], col))
    row, col = row[order], col[order]
    place = np.arange(len(col)) - np.searchsorted(col, col)
    return row[place < k], col[place < k]


def _by_blocks(queries: DataFrame, key: str, columns: list[Column], numbers: Column, one: Callable[[object], DataFrame], none: str) -> DataFrame:
    """The union of one(block) over blocks of queries of at most BLOCK_BYTES. Of several blocks each is stored before the next one is read, so that one block is held at a time."""
    spark = queries.sparkSession
    ship(spark)
    total = queries.agg(F.sum(numbers)).first()[0]
    if not total:
        return spark.createDataFrame([], none)
    blocks = -(-8 * total // BLOCK_BYTES)
    out = None
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block) if blocks > 1 else queries
        sent = spark.sparkContext.broadcast([c.to_pylist() for c in own.select(*columns).toArrow().columns])
        part = one(sent)
        if blocks > 1:
            part = stored(part)
            sent.unpersist()
        out = part if out is None else out.union(part)
    return out


def cosine_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query_key, key, score, rank: the k rows nearest to each query by cosine, exactly; ties by key.

    Queries go out in blocks of bounded size, one after the other; rows meet a block in matrix products of bounded size, of which
    each keeps its own k best, so only these are shuffled. Rows with a null vector are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    out = f"query_key {kind}, {key} {kind}, score double"

    def one(sent) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            names, q = np.array(ids), _unit(np.array(vectors, np.float64))
            step = max(1, MATRIX // max(1, len(ids)))
            for whole in batches:
                for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    keys = np.array(b.column(0).to_pylist())
                    score = np.round(_unit(_matrix(b.column(1))) @ q.T, 6) + 0.0
                    row, col = best(score, keys, k)
                    yield pa.RecordBatch.from_arrays([pa.array(names[col], b.column(0).type), pa.array(keys[row], b.column(0).type), pa.array(score[row, col])], names=["query_key", key, "score"])

        return rows.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, out)

    held = queries.filter(F.col(vector).isNotNull()).select(key, vector)
    return top_k(_by_blocks(held, key, [F.col(key), F.col(vector)], F.size(vector), one, out), "query_key", key, k)


def hash_bucket(token: Column, dim: int) -> Column:
    """int(md5(token)) mod dim, folded over four 32-bit limbs."""
    digest = F.md5(token)
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        limb = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit((1 << 32) % dim) + limb) % dim
    return acc.cast("int")


def hash_counts(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """key, bucket, n: the non-zero entries of the hashed bag of words."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("t")).groupBy(key, hash_bucket(F.col("t"), dim).alias("bucket")).agg(F.count("*").alias("n"))


def hash_vectors(df: DataFrame, key: str, text: str, dim: int = 512) -> DataFrame:
    """key, v: dense hashed bags of words; a text without words is a zero vector. No shuffle: words become buckets in the JVM, a batch of rows is counted at once."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 2000) for x in batches for i in range(0, x.num_rows, 2000)):
            held = b.column(1)
            row = np.repeat(np.arange(b.num_rows), np.asarray(held.value_lengths()))
            flat = np.bincount(row * dim + np.asarray(held.flatten()), minlength=b.num_rows * dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(flat))], names=["k", "v"])

    return df.select(F.col(key).alias("k"), F.transform(tokens(F.col(text)), lambda t: hash_bucket(t, dim)).alias("b")).mapInArrow(run, f"k {kind}, v array<double>").withColumnRenamed("k", key)


def arms(query: Column, document: Column) -> dict[str, Column]:
    """The texts that the arms of a query-vector study embed; document is one written for the query, null where there is none."""
    return {"raw": query, "half": F.substring(document, F.lit(1), F.floor(F.length(document) / 2).cast("int")), "concat": F.concat(query, F.lit(" "), document), "query_prompt": F.concat(F.lit("query: "), query), "passage_prompt": F.concat(F.lit("passage: "), query)}


def document_tokens(words: Column, most: int = 300) -> Column:
    """A document's tokens for late interaction: without punctuation, at most so many; the first one where all are punctuation."""
    kept = F.filter(words, lambda t: ~t.rlike(r"\A[!-/:-@\[-`{-~]+\z"))
    return F.when(F.size(kept) == 0, F.slice(words, 1, 1)).otherwise(F.slice(kept, 1, most))


def query_tokens(words: Column, n: int = 32, mask: str = "[MASK]") -> Column:
    """A query's tokens for late interaction: cut or filled up with masks to exactly so many."""
    return F.slice(F.concat(words, F.array_repeat(F.lit(mask), n)), 1, n)


def embed(df: DataFrame, key: str, text: str, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """key, v: vectors of length 1 by a model, loaded once a task by calling model(); null texts count as empty, zero vectors stay."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model()
        for b in (x.slice(i, batch) for x in batches for i in range(0, x.num_rows, batch)):
            m = _unit(np.asarray(encode([t or "" for t in b.column(1).to_pylist()]), np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))], names=["k", "v"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, v array<double>").withColumnRenamed("k", key)


def remote_model(key: str | None) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """The place of a model behind a service: refused without a key, before any job runs; none is offered here."""
    if not key:
        raise ValueError("a remote model needs a key")
    raise NotImplementedError("no remote model is offered")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over the query's vectors of the best dot product with one of the document's (arrays of arrays); null if either is empty."""
    each = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), F.aggregate(each, F.lit(0.0), lambda s, x: s + x))


def maxsim_top_k(queries: DataFrame, docs: DataFrame, key: str, vectors: str, k: int) -> DataFrame:
    """query_key, key, score, rank by late interaction; vectors is an array of equally long arrays. Empty documents are left out.

    Query documents go out in blocks of bounded size, one after the other; each batch of documents keeps its own k best.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = f"query_key {kind}, {key} {kind}, score double"

    def one(sent) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [(i, np.array(v, np.float64)) for i, v in zip(*sent.value)]
            for whole in batches:
                for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                    keys = np.array(b.column(0).to_pylist())
                    own = [np.array(v, np.float64) for v in b.column(1).to_pylist()]
                    cuts = np.cumsum([0, *(len(v) for v in own)])
                    flat = np.concatenate(own)
                    for i, q in asked:
                        score = np.round(np.maximum.reduceat(q @ flat.T, cuts[:-1], axis=1).sum(0), 6) + 0.0
                        row, _ = best(score[:, None], keys, k)
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(row), b.column(0).type), pa.array(keys[row], b.column(0).type), pa.array(score[row])], names=["query_key", key, "score"])

        return docs.filter(F.size(vectors) > 0).select(key, vectors).mapInArrow(run, out)

    held = queries.filter(F.size(vectors) > 0).select(key, vectors)
    return top_k(_by_blocks(held, key, [F.col(key), F.col(vectors)], F.size(F.flatten(vectors)), one, out), "query_key", key, k)
