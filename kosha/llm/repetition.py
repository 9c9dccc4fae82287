"""Problem 7: the share of repeated content inside one document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, window_hashes

#: Lengths in characters of the runs that are looked at.
LENGTHS = (10, 20, 50)
#: The run length and the share of repeats from which a text counts as repetitive.
FOUND_LENGTH, FOUND_SHARE = 20, 0.3


def _runs(values: np.ndarray, n: int) -> tuple[int, int, float]:
    """(runs, repeats of an earlier run, share of characters inside a run that occurs more than once)."""
    h = window_hashes(values, n)
    if not len(h):
        return 0, 0, 0.0
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    repeats = int(same.sum())
    if not repeats:
        return len(h), 0, 0.0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(values) + 1, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + n, -1)
    return len(h), repeats, float((np.cumsum(edge)[:-1] > 0).sum() / len(values))


def _lines(text: str) -> float:
    """The share of the characters of the lines that are in repeats of an earlier line."""
    seen, total, again = set(), 0, 0
    for line in text.split("\n"):
        line = line.replace(" ", "")
        if line:
            total += len(line)
            if line in seen:
                again += len(line)
            else:
                seen.add(line)
    return again / total if total else 0.0


def repetition(df: DataFrame, key: str, text: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per input row: key, n_chars, and for each n of lengths runs_n, repeats_n, share_n and covered_n; line_share.

    Text is taken without U+0020 and U+000A. share_n = repeats ÷ runs; covered_n = share of the
    characters that lie inside a run occurring at least twice. Null, empty and shorter texts have
    0 runs and share 0. Every row is on its own: no shuffle, whole texts, any length.
    """
    names = [f"{c}_{n}" for n in lengths for c in ("runs", "repeats", "covered")]
    schema = f"k {df.schema[key].dataType.simpleString()}, n_chars bigint, " + ", ".join(f"{c} {'double' if c[0] == 'c' else 'bigint'}" for c in names) + ", line_share double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                v = bare(t or "")
                got = [x for n in lengths for x in _runs(v, n)]
                rows.append([len(v), *got, _lines(t or "")])
            cols = list(zip(*rows)) if rows else [[]] * (len(names) + 2)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, pa.float64() if n[0] in "cl" else pa.int64()) for n, c in zip(["n_chars", *names, "line_share"], cols)], names=["k", "n_chars", *names, "line_share"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
    for n in lengths:
        out = out.withColumn(f"share_{n}", F.coalesce(F.try_divide(F.col(f"repeats_{n}").cast("double"), F.col(f"runs_{n}").cast("double")), F.lit(0.0)))
    return out


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of the texts of whose runs of 20 characters at least 0.3 repeat an earlier one (compared exactly, as 10·repeats ≥ 3·runs)."""
    got = repetition(df, key, text)
    return got.filter((F.col(f"runs_{FOUND_LENGTH}") > 0) & (10 * F.col(f"repeats_{FOUND_LENGTH}") >= 3 * F.col(f"runs_{FOUND_LENGTH}"))).select(key).distinct()
