"""Problem 6: pieces under a size limit that end at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: Strengths of boundaries: between blocks, lines, sentences, clauses, words.
BLOCK, LINE, SENTENCE, CLAUSE, WORD = 5, 4, 3, 2, 1
_SENTENCE = re.compile(r"[.!?][\"')\]”’]* +|[。！？।॥][”’」』）\"]*")
_CLAUSE = re.compile(r"[,;:] +|[，、；：]")
_WORD = re.compile(r" +|[一-鿿぀-ヿ](?=[一-鿿぀-ヿ])")


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of each maximal run of lines that hold more than U+0020; end exclusive, without the last line's break."""
    out: list[tuple[int, int]] = []
    at, start, end = 0, -1, 0
    for line in text.split("\n"):
        if line.strip(" "):
            if start < 0:
                start = at
            end = at + len(line)
        elif start >= 0:
            out.append((start, end))
            start = -1
        at += len(line) + 1
    if start >= 0:
        out.append((start, end))
    return out


def boundaries(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions at which a piece may end, with their strengths."""
    strength: dict[int, int] = {}
    for pattern, s in ((_WORD, WORD), (_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE)):
        for m in pattern.finditer(text):
            strength[m.end()] = s
    i = text.find("\n")
    while i >= 0:
        strength[i + 1] = LINE
        i = text.find("\n", i + 1)
    for start, _ in spans:
        if start:
            strength[start] = BLOCK
    for edge in (0, len(text)):
        strength.pop(edge, None)
    at = np.fromiter(strength, np.int64, len(strength))
    order = np.argsort(at)
    return at[order], np.fromiter(strength.values(), np.int64, len(strength))[order]


def _cut(n: int, at: np.ndarray, strength: np.ndarray, count: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """count pieces with ends snapped to the strongest boundary near their targets, or None if one is over the limit."""
    size = n / count
    reach = max(1, int(size // 4))
    pieces, start = [], 0
    for k in range(1, count + 1):
        if k == count:
            end = n
        else:
            target = round(k * size)
            low, high = max(start + overlap + 1, target - reach), min(start + limit, target + reach, n - 1)
            a, b = np.searchsorted(at, low), np.searchsorted(at, high, side="right")
            if b > a:
                near = at[a:b]
                best = np.lexsort((near, np.abs(near - target), -strength[a:b]))[0]
                end = int(near[best])
            else:
                end = min(target, start + limit)
                if end <= start + overlap:
                    return None
        if end - start > limit or end <= start:
            return None
        pieces.append((start, end))
        if k < count:
            a, b = np.searchsorted(at, end - overlap), np.searchsorted(at, end, side="right")
            start = int(at[a]) if b > a else end - overlap
    return pieces


def pieces(n: int, at: np.ndarray, strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most limit characters that cover 0..n; consecutive ones share up to overlap characters.

    Pieces are added while a snapped end leaves one over the limit. With 3 * count + 8 pieces more the targets lie so close that
    no snapping can; should all fail all the same, the text is cut at a fixed step, within the limit and with the full overlap.
    """
    if n <= limit:
        return [(0, n)] if n else []
    count = -(-(n - overlap) // (limit - overlap))
    for more in range(count, 4 * count + 8):
        if (got := _cut(n, at, strength, more, limit, overlap)) is not None:
            return got
    step = limit - overlap
    return [(s, min(n, s + limit)) for s in range(0, n - overlap, step)]


def split(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: key, blocks (those that don't fit into one piece) and pieces (start, end, strength of the end).

    The least number of pieces that can do is planned with equally spaced ends, each end is snapped to
    the strongest boundary within a quarter of a piece, and a piece is added while one is over
    the limit. A text without boundaries is cut at the targets themselves. Null and empty texts have
    no pieces; a text within the limit is one piece. Positions are code points from 0.
    """
    schema = f"k {df.schema[key].dataType.simpleString()}, oversized array<struct<block_no:int,start_pos:int,end_pos:int>>, pieces array<struct<piece_no:int,start_pos:int,end_pos:int,strength:int>>"
    big = pa.list_(pa.struct([("block_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))
    small = pa.list_(pa.struct([("piece_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("strength", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            over, cut = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                if len(t) <= limit:
                    over.append([])
                    cut.append([(0, 0, len(t), BLOCK)] if t else [])
                    continue
                spans = blocks(t)
                at, strength = boundaries(t, spans)
                over.append([])
                for i, (s, e) in enumerate(spans):
                    # a block's own balanced cut tells whether it fits into one piece
                    a, z = np.searchsorted(at, s, side="right"), np.searchsorted(at, e)
                    if len(pieces(e - s, at[a:z] - s, strength[a:z], limit, overlap)) > 1:
                        over[-1].append((i, s, e))
                kept = dict(zip(at.tolist(), strength.tolist()))
                cut.append([(i, s, e, BLOCK if e == len(t) else kept.get(e, 0)) for i, (s, e) in enumerate(pieces(len(t), at, strength, limit, overlap))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("block_no", "start_pos", "end_pos"), x)) for x in o] for o in over], big), pa.array([[dict(zip(("piece_no", "start_pos", "end_pos", "strength"), x)) for x in c] for c in cut], small)], names=["k", "oversized", "pieces"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def piece_rows(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """split(), a row per piece: key, piece_no, start_pos, end_pos, strength."""
    return split(df, key, text, limit, overlap).select(key, F.inline("pieces"))


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and block_no of the blocks over the limit, as the splitter meets them."""
    return split(df, key, text).select(key, F.explode("oversized").alias("b")).select(key, F.col("b.block_no").alias("block_no")).distinct()
