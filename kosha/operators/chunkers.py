"""Chunkers: one document to many chunks, in order.

All keep the document's own order and give pieces in code points. Null and empty texts give no chunks.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = r"^\s*##\s*Page\s+(\d+)\s*$"


def pages(text: Column) -> Column:
    """array<struct<page,body>>: parts between "## Page N" lines, trimmed, blank ones left out; text before the first mark is page 1."""
    marked = F.split(F.regexp_replace(text, r"(?m)^[ \t]*##[ \t]*Page[ \t]+([0-9]+)[ \t]*$", "\u0001$1\u0002"), "\u0001")
    each = F.transform(marked, lambda p: F.struct(F.when(F.contains(p, F.lit("\u0002")), F.substring_index(p, "\u0002", 1).cast("int")).otherwise(1).alias("page"), F.btrim(F.substring_index(p, "\u0002", -1), F.lit(" \n\t")).alias("body")))
    return F.filter(each, lambda p: p["body"] != "")


def fixed_size(text: Column, size: int = 512, overlap: int = 0) -> Column:
    """Windows of size characters every size - overlap, also those inside the one before."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def pack(units: Column, size: int) -> Column:
    """Whole units joined greedily up to size characters; a longer unit stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    step = lambda a, u: F.when(F.length(a["now"]) + F.length(u) <= size, F.struct(a["done"].alias("done"), F.concat(a["now"], u).alias("now"))).otherwise(F.struct(F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])).alias("done"), u.alias("now")))
    return F.aggregate(units, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def sentences(text: Column) -> Column:
    """A plain splitter: a part ends after a terminator with the spaces that follow, or after a line break."""
    return F.filter(F.split(text, r"(?<=[.!?] )|(?<=[。！？।])|(?<=\n)"), lambda s: s != "")


def merge_short(units: Column, least: int = 15) -> Column:
    """Units collected until they have the least length; what is left over joins the last."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, u: Column) -> Column:
        now = F.concat(a["now"], u)
        return F.when(F.length(now) >= least, F.struct(F.array_append(a["done"], now).alias("done"), F.lit("").alias("now"))).otherwise(F.struct(a["done"].alias("done"), now.alias("now")))

    def end(a: Column) -> Column:
        n = F.size(a["done"])
        last = F.concat(F.element_at(a["done"], -1), a["now"])
        return F.when(a["now"] == "", a["done"]).when(n == 0, F.array(a["now"])).otherwise(F.array_append(F.slice(a["done"], F.lit(1), n - 1), last))

    return F.aggregate(units, start, step, end)


def chunk_rows(df: DataFrame, key: str, text: str, split: Callable[[Column], Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """key, chunk_index over the whole document, page, chunk and the document's columns to keep: pages first, then the splitter within each; no shuffle."""
    cut = F.transform(pages(F.col(text)), lambda p: F.transform(split(p["body"]), lambda c: F.struct(p["page"].alias("page"), c.alias("chunk"))))
    rows = df.select(key, *keep, F.posexplode(F.flatten(cut)).alias("chunk_index", "c"))
    return rows.select(key, *keep, "chunk_index", "c.page", "c.chunk")


def semantic_groups(df: DataFrame, doc: str, order: str, vector: str, threshold: float = 0.5) -> DataFrame:
    """doc, order, group_no: a group ends where a unit's vector and the one before are less similar; a zero vector has similarity 0."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(doc).orderBy(order)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    before = df.withColumn("before", F.lag(vector).over(w))
    norm = F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("before"), F.col("before")))
    near = F.when(norm > 0, dot(F.col(vector), F.col("before")) / norm).otherwise(0.0)
    broken = before.withColumn("cut", F.when(F.col("before").isNull(), 0).otherwise((near < threshold).cast("int")))
    return broken.select(doc, order, F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("group_no"))


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Cuts at the coarsest separator present, goes on with finer ones inside long parts, joins neighbours up to the size.

    A running length goes with the parts that are held, so that each part is added and taken off once.
    """
    rest = separators
    while rest and rest[0] and rest[0] not in text:
        rest = rest[1:]
    sep = rest[0] if rest else ""
    parts = (p for p in (text.split(sep) if sep else text) if p)
    out: list[str] = []
    held: collections.deque[str] = collections.deque()
    length = 0  # of the held parts, joined

    def drop() -> None:
        nonlocal length
        length -= len(held.popleft()) + (len(sep) if held else 0)

    def close() -> None:
        if joined := sep.join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) > size:
            close()
            held.clear()
            length = 0
            out += recursive(p, size, overlap, rest[1:])
            continue
        if held and length + len(sep) + len(p) > size:
            close()
            while held and (length > overlap or length + len(sep) + len(p) > size):
                drop()
        length += len(p) + (len(sep) if held else 0)
        held.append(p)
    close()
    return out


def semantic(text: Column, threshold: float = 0.5, dim: int = 64) -> Column:
    """Chunks that end where a sentence is less like the one before than the threshold, by the cosine of hashed bags of words; without words the cosine is 0.

    Short sentences are merged first. The comparison is of squares, in whole numbers for a threshold of a half.
    """
    from .dense import hash_bucket
    from .lexical import tokens

    dot = lambda a, b: F.aggregate(F.transform(a, lambda x: F.size(F.filter(b, lambda y: y == x))), F.lit(0).cast("bigint"), lambda s, n: s + n)
    units = F.transform(merge_short(sentences(text)), lambda u: F.struct(u.alias("u"), F.transform(tokens(u), lambda t: hash_bucket(t, dim)).alias("b")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.array().cast("array<int>").alias("b"))

    def step(a: Column, x: Column) -> Column:
        d = dot(a["b"], x["b"])
        like = (d > 0) & (d * d >= threshold * threshold * dot(a["b"], a["b"]) * dot(x["b"], x["b"]))
        return F.when((a["now"] == "") | like, F.struct(a["done"].alias("done"), F.concat(a["now"], x["u"]).alias("now"), x["b"].alias("b"))).otherwise(F.struct(F.array_append(a["done"], a["now"]).alias("done"), x["u"].alias("now"), x["b"].alias("b")))

    return F.aggregate(units, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def word_spans(sizes: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of the chunks over words of the given lengths, found by bisection in the running total.

    A chunk takes the words that fit, one at least. The next one starts at the last word from which the overlap is reached;
    where that is the chunk's own start, at its end.
    """
    total = list(itertools.accumulate(sizes, initial=0))
    out: list[tuple[int, int]] = []
    first = 0
    while first < len(sizes):
        end = max(first + 1, bisect.bisect_right(total, total[first] + size) - 1)
        out.append((first, end))
        back = bisect.bisect_right(total, total[end] - overlap) - 1
        first = end if end == len(sizes) or back <= first else back
    return out


def words(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of whole words, each with the white space after it; white space before the first word is left out."""
    parts = re.findall("[^ \t\n\r\f\v]+[ \t\n\r\f\v]*", text)
    return ["".join(parts[a:b]) for a, b in word_spans(list(map(len, parts)), size, overlap)]


def python_chunks(df: DataFrame, key: str, text: str, how: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """key, chunk_index, chunk by the recursive or the word-aware splitter, whose state has no expression form."""
    split = {"recursive": recursive, "words": words}[how]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b["k"], b["t"]) if t for i, c in enumerate(split(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["k", "chunk_index", "chunk"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_index int, chunk string").withColumnRenamed("k", key)
