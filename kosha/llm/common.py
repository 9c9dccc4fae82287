"""Helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def codepoints(text: str) -> np.ndarray:
    """The text's code points as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bare(text: str) -> np.ndarray:
    """Scrambled code points of the text without U+0020 and U+000A."""
    return mix(codepoints(text.replace(" ", "").replace("\n", "")).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Rolling 64-bit hash of every run of n values, by doubling: O(log n) vector passes."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    done, width = None, 0
    piece, size, rest = values, 1, n
    while rest:
        if rest & 1:
            if done is None:
                done, width = piece, size
            else:
                m = len(values) - width - size + 1
                done = done[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + piece[width : width + m]
                width += size
        rest >>= 1
        if rest:
            m = len(piece) - size
            piece = piece[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + piece[size : size + m]
            size *= 2
    return mix(done)


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values; several times faster here than numpy's own."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row once for every pair (i, j), i <= j, of its part with one of the parts (columns part and parts)."""
    other = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.select(*columns, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def met(rows: DataFrame, keys: list[str], value: str, block: int) -> DataFrame:
    """keys, a, b: all pairs a < b of values with equal keys. The values of a key are counted first and dealt out in parts of about block; each two parts are joined on their own."""
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("n") > 1).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    each = dealt(counted.withColumn("part", F.pmod(F.xxhash64(value), "parts").cast("int")), [*keys, value, "part"])
    both = each.alias("x").join(each.alias("y"), [*keys, "i", "j"]).filter(f"x.{value} < y.{value} and i = j or x.part < y.part")
    return both.select(*keys, F.least(f"x.{value}", f"y.{value}").alias("a"), F.greatest(f"x.{value}", f"y.{value}").alias("b"))
