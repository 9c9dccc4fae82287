"""Runs, repeats and audits, by windows (gaps and islands)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of one value in order: keys, value, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = df.withColumn("new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    run = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run", value).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("run")


def line_repeats(df: DataFrame, key: str, text: str, chars: int = 20, times: int = 4) -> DataFrame:
    """Lines of at least so many characters that stand so often in a row: key, line, start, end, n."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select(key, "pos", F.btrim("raw", F.lit(" \t\r")).alias("line"))
    return islands(lines, [key], "pos", "line").filter((F.col("n") >= times) & (F.length("line") >= chars))


def token_runs(df: DataFrame, key: str, text: str, times: int = 8) -> DataFrame:
    """The same word so often in a row, outside tables: key, token, start, end, n."""
    bare = F.regexp_replace(text, "<table[^\n]*</table>", " ")
    words = df.select(key, F.posexplode(F.filter(F.split(bare, "[ \n\t]+"), lambda t: t != "")).alias("pos", "token"))
    return islands(words, [key], "pos", "token").filter(F.col("n") >= times)


TABLES = "(?is)<table.*?</table>"


def numeric_flood(df: DataFrame, key: str, text: str, times: int = 8) -> DataFrame:
    """Words "N." inside a table that count up by one, word after word, so often: key, table_no, first, n, word_no of the first.

    A word in between ends a run. Null and empty texts, and texts without tables, give none. No shuffle: each table is one fold.
    """
    spot = F.struct(F.array().cast("array<struct<first:bigint,n:bigint,at:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at"))
    run = lambda a: F.struct(a["first"].alias("first"), a["n"].alias("n"), (a["at"] - a["n"]).alias("at"))
    closed = lambda a: F.when(a["n"] >= times, F.array_append(a["done"], run(a))).otherwise(a["done"])

    def step(a: Column, w: Column) -> Column:
        v = F.nullif(F.regexp_extract(w, r"\A([0-9]{1,15})\.\z", 1), F.lit("")).cast("bigint")
        goes_on = F.coalesce(v == a["first"] + a["n"], F.lit(False))
        begun = F.struct(closed(a).alias("done"), v.alias("first"), v.isNotNull().cast("bigint").alias("n"), (a["at"] + 1).alias("at"))
        return F.when(goes_on, F.struct(a["done"].alias("done"), a["first"].alias("first"), (a["n"] + 1).alias("n"), (a["at"] + 1).alias("at"))).otherwise(begun)

    tables = df.select(key, F.posexplode(F.regexp_extract_all(F.translate(text, "๐๑๒๓๔๕๖๗๘๙", "0123456789"), F.lit(TABLES), F.lit(0))).alias("table_no", "t"))
    tokens = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    return tables.select(key, "table_no", F.explode(F.aggregate(tokens, spot, step, closed)).alias("r")).select(key, "table_no", "r.first", "r.n", F.col("r.at").alias("word_no"))


#: Fixed value: a person with an academic title, as rosters in tables have them.
TITLED = r"(?:ผศ|รศ)\.(?:ดร\.)?[ \t]*[ก-ฮะ-๎]+(?:[ \t]+[ก-ฮะ-๎]+){0,3}"


def table_name_loops(df: DataFrame, key: str, text: str, names: str = TITLED, least: int = 4, ratio: float = 0.5) -> DataFrame:
    """Names in so many rows of one table whose rows are nearly the same: key, table_no, name, n, n_rows_different.

    A name counts once a row; rows are compared with digits as 0 and white space as one space.
    """
    from kosha.functions.text import collapse_ws, row_signature

    tables = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(TABLES), F.lit(0))).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.explode(F.regexp_extract_all("t", F.lit("(?is)<tr>.*?</tr>"), F.lit(0))).alias("row"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("row", F.lit(names), F.lit(0)), collapse_ws))
    each = rows.select(key, "table_no", row_signature(F.col("row")).alias("sig"), F.explode(found).alias("name"))
    n = each.groupBy(key, "table_no", "name").agg(F.count("*").alias("n"), F.count_distinct("sig").alias("n_rows_different"))
    return n.filter((F.col("n") >= least) & (F.col("n_rows_different") <= ratio * F.col("n")))


#: Fixed value: words of rules and marks, whose cycles say nothing.
BENIGN = r"[\-_=|.*#]*"


def word_cycles(words: list[str], times: int = 6, most: int = 8) -> Iterator[tuple[int, int, int]]:
    """(place, period, cycles) of each cycle, one after the other."""
    _, at = np.unique(np.array(words, dtype=object), return_inverse=True) if words else ((), np.zeros(0, int))
    plain = np.array([re.fullmatch(BENIGN, w) is None for w in words], bool)
    left = np.zeros((most + 1, len(words) + 1), np.int64)  # by period and place: words from here on that equal the one a period later
    for p in range(2, most + 1):
        same = at[:-p] == at[p:]
        ends = np.flatnonzero(np.append(~same, True))
        place = np.arange(len(same))
        left[p, : len(same)] = ends[np.searchsorted(ends, place)] - place
    long = left >= (times - 1) * np.arange(most + 1)[:, None]
    long[:2] = False
    i = 0
    for i_next in np.flatnonzero(long.any(0)).tolist():
        if i_next < i:
            continue
        for p in np.flatnonzero(long[:, i_next]).tolist():
            if plain[i_next : i_next + p].any():
                n = int(left[p, i_next]) // p + 1
                yield i_next, p, n
                i = i_next + p * n
                break


def cyclic_floods(df: DataFrame, key: str, text: str, times: int = 6, most: int = 8) -> DataFrame:
    """Word cycles of 2 to most words that run so often, the shortest period first: key, start, period, n. Cycles of rules and marks alone are none.

    Words are numbers; for each period the stretches in which a word equals the one a period before are found at once, and
    only places where a stretch is long enough are looked at.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *f) for k, t in zip(b["k"], b["t"]) for f in word_cycles((t or "").split(), times, most)], columns=["k", "start", "period", "n"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, start int, period int, n int").withColumnRenamed("k", key)


def without_line_loops(df: DataFrame, key: str, text: str, chars: int = 20, times: int = 4) -> DataFrame:
    """key and the text with every long run of one line cut to its first line."""
    lines = F.split(text, "\n")
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("run"), F.lit("").alias("of"))
    close = lambda a: F.concat(a["done"], F.when((F.size(a["run"]) >= times) & (F.length(a["of"]) >= chars), F.slice(a["run"], 1, 1)).otherwise(a["run"]))

    def step(a: Column, x: Column) -> Column:
        same = (a["of"] == x["t"]) & (F.size(a["run"]) > 0)
        return F.when(same, F.struct(a["done"].alias("done"), F.array_append(a["run"], x["raw"]).alias("run"), a["of"].alias("of"))).otherwise(F.struct(close(a).alias("done"), F.array(x["raw"]).alias("run"), x["t"].alias("of")))

    both = F.zip_with(lines, trimmed, lambda r, t: F.struct(r.alias("raw"), t.alias("t")))
    return df.select(key, F.array_join(F.aggregate(both, start, step, close), "\n").alias(text))


def without_loops(text: str, times: int = 6, lines: int = 4, chars: int = 20) -> tuple[str, int]:
    """The text with the first cycle of each loop of words and the first line of each run of lines, and the characters cut.

    What is left of a further, broken cycle goes too. A table that the cut leaves open is closed. Cuts don't overlap and are made from the end.
    """
    cuts: list[tuple[int, int]] = []
    at = 0
    run: list[tuple[int, int, str]] = []
    for line in [*text.split("\n"), None]:
        bare = line.strip(" \t\r") if line is not None else None
        if run and run[-1][2] != bare:
            if len(run) >= lines and len(run[0][2]) >= chars:
                cuts.append((run[0][1], run[-1][1]))
            run = []
        if line is not None:
            run.append((at, at + len(line), bare))
            at += len(line) + 1
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    words = [text[a:b] for a, b in spans]
    for i, period, n in word_cycles(words, times):
        end = i + period * n
        while end < len(words) and words[end] == words[end - period] and end - i - period * n < period:
            end += 1
        cut = (spans[i + period - 1][1], spans[end - 1][1])
        if all(cut[1] <= a or cut[0] >= b for a, b in cuts):
            cuts.append(cut)
    out, gone = text, 0
    for a, b in sorted(cuts, reverse=True):
        piece = out[a:b]
        close = "</table>" * max(0, piece.lower().count("</table>") - piece.lower().count("<table"))
        out, gone = out[:a] + close + out[b:], gone + b - a
    return out, gone


def excised(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text without its loops, n_cut (see without_loops); null stays null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(None, 0) if t is None else without_loops(t) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "t": [x for x, _ in done], "n_cut": [n for _, n in done]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, t string, n_cut bigint").select(F.col("k").alias(key), F.col("t").alias(text), "n_cut")


def duplicates(df: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """Groups of rows with one text: hash, n, n_groups, least key, kind (one or several groups). Null and blank texts are no duplicates."""
    own = df.filter(F.trim(text) != "").select(F.sha2(text, 256).alias("hash"), key, group)
    g = own.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), F.min(key).alias("first"))
    return g.filter("n > 1").withColumn("kind", F.when(F.col("n_groups") > 1, "across").otherwise("within"))


def components(edges: DataFrame, a: str, b: str, stored) -> DataFrame:
    """node, label (the least node reachable): labels spread along edges and along labels until none falls.

    The lineage is cut after every round by `stored`.
    """
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = stored(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
        step = labels.join(near, "x").select("x", "label", F.least("label", "other").alias("new"))
        after = stored(step.join(step.select(F.col("x").alias("new"), F.col("new").alias("further")), "new", "left").select("x", F.least("new", F.coalesce("further", "new")).alias("label"), F.col("label").alias("old")))
        labels = after.select("x", "label")
        if after.filter("label < old").isEmpty():
            return labels.withColumnRenamed("x", "node")
