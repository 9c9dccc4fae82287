"""Resampling and test statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kosha.session import stored

#: Fixed values of the portable draw: a prime modulus, and a factor and shifts that spread resamples and places.
MODULUS, FACTOR, BY_RESAMPLE, BY_PLACE = 2147483647, 48271, 7368787, 2750159


def hashed(seed: Column, n: Column) -> Column:
    """A portable choice from 0..n-1 by the first 8 hex digits of md5."""
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint") % n


def draws(resamples: np.ndarray, n: int) -> np.ndarray:
    """A matrix of draws from 0..n-1, a row for each resample number; made of squares modulo a prime, so that SQL can repeat it."""
    b, i = resamples[:, None].astype(np.int64), np.arange(n, dtype=np.int64)[None, :]
    x = (b * BY_RESAMPLE + i * BY_PLACE + 12345) % MODULUS
    x = (x * x + FACTOR * i + b) % MODULUS
    x = (x * x + FACTOR) % MODULUS
    return (x // 8) % n


@lru_cache(4)
def _drawn(first: int, end: int, n: int) -> np.ndarray:
    """A block of draws, kept for the next group of as many items."""
    return draws(np.arange(first, end), n).astype(np.int32)


def draws_sql(b: str, i: str, n: str) -> str:
    """The same draw as SQL, from expressions of BIGINT."""
    x = f"(({b}) * {BY_RESAMPLE} + ({i}) * {BY_PLACE} + 12345) % {MODULUS}"
    y = f"(({x}) * ({x}) + {FACTOR} * ({i}) + ({b})) % {MODULUS}"
    return f"(((({y}) * ({y}) + {FACTOR}) % {MODULUS}) // 8) % ({n})"


#: Numbers of a matrix of draws that are in memory at once.
DRAWN = 4_000_000


def away(x: np.ndarray | float, places: int) -> np.ndarray:
    """Rounded, halves away from zero, as SQL does."""
    return np.sign(x) * np.floor(np.abs(x) * 10**places + 0.5) / 10**places + 0.0


def resampled_means(diffs: np.ndarray, n_boot: int) -> np.ndarray:
    """The mean of each resample. Differences are whole millionths, so that the sums are exact."""
    micro = away(diffs * 1e6, 0).astype(np.int64)
    step = max(1, DRAWN // max(1, len(micro)))
    sums = [micro[_drawn(a, min(a + step, n_boot), len(micro))].sum(1) for a in range(0, n_boot, step)]
    return away(np.concatenate(sums) / len(micro) / 1e6, 9)


def bootstrap(diffs: DataFrame, group: str, item: str, diff: str, n_boot: int = 10_000) -> DataFrame:
    """group, n, mean, p, low, high: paired bootstrap of the mean difference, two-sided, percentile interval.

    A group is one number per judged query, in the order of item; its resamples are drawn as matrices. Differences are taken
    to six decimals. Null differences are left out; a group without any gives no row.
    """
    kind = diffs.schema[group].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values(["i"])["d"].to_numpy()
        m = resampled_means(d, n_boot)
        p = min(1.0, 2 * min((m <= 0).mean(), (m >= 0).mean()))
        low, high = np.percentile(m, [2.5, 97.5])
        return pd.DataFrame([(rows["g"].iloc[0], len(d), *(float(away(x, 6)) for x in (d.mean(), p, low, high)))], columns=["g", "n", "mean", "p", "low", "high"])

    own = diffs.filter(F.col(diff).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(diff).cast("double").alias("d"))
    # few groups, much work in each: one task a group, not as few as their bytes ask for
    parts = own.sparkSession.sparkContext.defaultParallelism
    return own.repartition(parts, "g").groupBy("g").applyInPandas(run, f"g {kind}, n int, mean double, p double, low double, high double").withColumnRenamed("g", group)


#: Keys of a block: all pairs of two blocks are one piece of work.
BLOCK = 1024


def blocks(df: DataFrame, group: str, key: str, item: str, value: str, varied: bool = False) -> DataFrame:
    """group, key, v, block, at: the values of each key in the order of item, the keys of a group dealt into blocks in their order. Null groups, keys and items are left out; a key has a value for every item. varied: only keys of unequal values."""
    v = F.transform(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).cast("double").alias("x")))), lambda s: s["x"])
    own = df.dropna(subset=[group, key, item]).groupBy(group, key).agg(v.alias("v"))
    if varied:
        own = own.filter(F.array_min("v") < F.array_max("v"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1
    return stored(own.withColumn("n", n).select(group, key, "v", F.floor(F.col("n") / BLOCK).cast("int").alias("block"), (F.col("n") % BLOCK).alias("at")))


def paired(dealt: DataFrame, group: str, key: str, names: list[str], measure: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """group, key, block, skip and an array for each name: figures of a key with the later keys of its group, a row for each block of those, without its first skip keys.

    measure: a matrix of figures for each name from the values of two blocks (a row each key). Pairs are as many as keys squared and are kept in this form; pairs() gives a row each.
    """
    kind = {c: dealt.schema[c].dataType.simpleString() for c in (group, key)}

    def run(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        sides = [t.filter(pc.equal(t["block"], b)).sort_by("at") for b in (i, j)]
        if pc.count_distinct(pc.list_value_length(t["v"])).as_py() != 1:
            raise ValueError("a key has no value for an item")
        x, y = (s["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1) for s in sides)
        figures = measure(x, y)
        skip = np.arange(1, len(x) + 1) if i == j else np.zeros(len(x), int)
        places = np.triu_indices(len(x), 1, len(y)) if i == j else np.indices((len(x), len(y))).reshape(2, -1)
        ends = pa.array(np.concatenate([[0], np.cumsum(len(y) - skip)]), pa.int32())
        arrays = [pa.ListArray.from_arrays(ends, pa.array(f[places[0], places[1]], pa.float64())) for f in figures]
        return pa.Table.from_arrays([sides[0][group], sides[0][key], pa.array(np.full(len(x), j), pa.int32()), pa.array(skip, pa.int32()), *arrays], [group, key, "block", "skip", *names])

    last = F.max("block").over(Window.partitionBy(group))
    met = dealt.withColumn("last", last).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("last")))).select(group, key, "v", "block", "at", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    # few groups, much work in each: dealt to more tasks than their bytes ask for
    dealt_out = met.repartition(4 * met.sparkSession.sparkContext.defaultParallelism, group, "i", "j")
    out = f"{group} {kind[group]}, {key} {kind[key]}, block int, skip int, " + ", ".join(f"{n} array<double>" for n in names)
    return dealt_out.groupBy(group, "i", "j").applyInArrow(run, out)


def pairs(figures: DataFrame, dealt: DataFrame, group: str, key: str, names: list[str], wanted: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """group, a, b and a figure for each name: a row for each pair of paired(); wanted filters pairs or adds columns before b is looked up."""
    others = dealt.groupBy(group, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", key))), lambda s: s[key]).alias("others"))
    rows = figures.withColumnRenamed(key, "a").join(others, [group, "block"])
    each = rows.select("*", F.posexplode(names[0]).alias("pos", "first")).select(group, "a", "others", "skip", "pos", F.col("first").alias(names[0]), *[F.col(n)[F.col("pos")].alias(n) for n in names[1:]])
    return wanted(each).withColumn("b", F.col("others")[F.col("skip") + F.col("pos")]).drop("others", "skip", "pos")


@lru_cache(8)
def _counted(first: int, end: int, n: int) -> np.ndarray:
    """How often each resample of a block draws each item."""
    places = draws(np.arange(first, end), n) + n * np.arange(end - first)[:, None]
    return np.bincount(places.ravel(), minlength=(end - first) * n).reshape(-1, n).astype(float)


def tested(x: np.ndarray, y: np.ndarray, n_boot: int) -> list[np.ndarray]:
    """Mean and p of bootstrap() for the difference of each row of x and each of y, values of six decimals.

    The sum of a resample of differences is the difference of two sums of the same resample, so that each row is resampled once; equal rows are taken once.
    """
    (a, ia), (b, ib) = (np.unique(np.rint(m * 1e6), axis=0, return_inverse=True) for m in (x, y))
    n = a.shape[1]
    mean = np.stack([((own - b) / 1e6).mean(1) for own in a])
    small = np.arange(1, n // 1000 + 3)
    least = int(small[away(small / n / 1e6, 9) > 0][0])  # a sum nearer to 0 has a mean that is rounded to 0
    kind = np.int32 if n * max(np.abs(a).max(), np.abs(b).max()) + least < 2**31 else np.int64
    below, above = np.zeros(mean.shape, np.int64), np.zeros(mean.shape, np.int64)
    step = max(1, min(5000, DRAWN // n))
    for first in range(0, n_boot, step):
        counted = _counted(first, min(first + step, n_boot), n)
        sa, sb = ((m @ counted.T).astype(kind) for m in (a, b))  # whole numbers below 2**53: exact
        for k, own in enumerate(sa):
            below[k] += [np.count_nonzero(r) for r in sb > own - least]
            above[k] += [np.count_nonzero(r) for r in sb < own + least]
    p = np.minimum(1.0, 2 * np.minimum(below / n_boot, above / n_boot))
    return [m[ia.ravel()[:, None], ib.ravel()[None, :]] for m in (away(mean, 6), away(p, 6))]


def correlated(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Pearson's correlation of each row of x and each of y; no row is constant."""
    x, y = (m - m.mean(1, keepdims=True) for m in (x, y))
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    return [away(x @ y.T, 5)]


def power(diffs: DataFrame, group: str, item: str, diff: str, effects: list[float], trials: int = 200, n_boot: int = 500, alpha: float = 0.05) -> DataFrame:
    """group, effect, power: how often a bootstrap test finds an effect that is put into resamples of the centred differences."""
    kind = diffs.schema[group].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values(["i"])["d"].to_numpy()
        centred = away(d - d.mean(), 6)
        picked = centred[draws(np.arange(n_boot, n_boot + trials), len(d))]
        out = []
        for e in effects:
            found = 0
            for own in picked + e:
                m = resampled_means(own, n_boot)
                found += min(1.0, 2 * min((m <= 0).mean(), (m >= 0).mean())) < alpha
            out.append((rows["g"].iloc[0], e, round(found / trials, 6)))
        return pd.DataFrame(out, columns=["g", "effect", "power"])

    own = diffs.filter(F.col(diff).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(diff).cast("double").alias("d"))
    return own.repartition(own.sparkSession.sparkContext.defaultParallelism, "g").groupBy("g").applyInPandas(run, f"g {kind}, effect double, power double").withColumnRenamed("g", group)


def holm(df: DataFrame, family: list[str], key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down correction in each family: adjusted (running greatest of (m-i+1)·p, at most 1) and reject."""
    w = Window.partitionBy(*family).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*family))
    stepped = df.withColumn("step", (m - F.row_number().over(w) + 1) * F.col(p))
    adjusted = F.least(F.lit(1.0), F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return stepped.withColumn("adjusted", F.round(adjusted, 6)).withColumn("reject", F.col("adjusted") <= alpha).drop("step")


def holm_levels(counts: DataFrame, family: str, p: str, n: str, alpha: float = 0.05) -> DataFrame:
    """family, p, adjusted, reject of holm() from how many tests of a family have each p: tests of equal p have the value of the first of them, so no family is sorted as a whole."""
    w = Window.partitionBy(family).orderBy(p)
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stepped = counts.withColumn("step", (F.sum(n).over(Window.partitionBy(family)) - before) * F.col(p))
    adjusted = F.least(F.lit(1.0), F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return stepped.select(family, p, F.round(adjusted, 6).alias("adjusted")).withColumn("reject", F.col("adjusted") <= alpha)


def mde(sd: Column, n: Column, alpha: float = 0.05, tests: Column | int = 1) -> Column:
    """The least difference found with power 0.8, by the normal approximation, at alpha ÷ tests (z by a rational approximation)."""
    a = F.lit(alpha) / tests / 2
    t = F.sqrt(-2 * F.log(a))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return (z + 0.8416212) * sd / F.sqrt(n)


def needed(sd: Column, delta: float, alpha: float = 0.05, tests: Column | int = 1) -> Column:
    """The number of items for which a difference of delta is found with power 0.8; null for a delta of 0."""
    one = mde(sd, F.lit(1), alpha, tests)
    return F.ceil(F.try_divide(one * one, F.lit(delta * delta)))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a share; null without trials."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def kendall(pairs: DataFrame, group: list[str], x: str, y: str, item: str) -> DataFrame:
    """tau-b by the signs of all pairs of one group's items (a ranking's top k, so a few dozens)."""
    a, b = pairs.alias("a"), pairs.alias("b")
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]
    both = a.join(b, [*same, F.col(f"a.{item}") < F.col(f"b.{item}")])
    sx, sy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    agg = both.groupBy(*[F.col(f"a.{g}").alias(g) for g in group]).agg(F.sum(sx * sy).alias("s"), F.sum(sx * sx).alias("xx"), F.sum(sy * sy).alias("yy"))
    return agg.select(*group, F.round(F.try_divide(F.col("s"), F.sqrt(F.col("xx") * F.col("yy"))), 6).alias("tau"))


def stratified(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """About n rows: of each stratum max(1, round(n·share)), by hash order of the key."""
    total = df.count()
    counts = df.groupBy(stratum).agg(F.count("*").alias("size"))
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    # no quota is over n: a constant limit cuts each stratum before it is shuffled
    first = df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(1, n))
    return first.join(counts, stratum).filter(F.col("r") <= F.greatest(F.lit(1), F.round(n * F.col("size") / F.lit(max(total, 1))))).drop("r", "size")
