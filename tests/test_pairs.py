"""Comparisons of all pairs: against plain loops, and over more combinations than a bootstrap or a join of rows for each pair gets through."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from kosha.operators import audits, metrics, stats
from kosha.plans.ranking_queries import N_BOOT


def tables(spark, path, families, n, p_hit):
    """Rankings of one row for each of 12 queries, n combinations a family; a hit at rank 1 to 3 with a chance that differs by family."""
    rnd = random.Random(5)
    rows = []
    for f in families:
        for c in range(n):
            for q in range(12):
                rank = rnd.randint(1, 3)
                hit = rnd.random() < p_hit(f, c)
                rows.append((f"{f}-x-{c:04d}", q, rank, f"c{q}", f"d{q}" if hit else "none", None, 0.5, "r", None))
    rows += rows[:5]
    spark.createDataFrame(rows, "combination_id string, query_id int, rank int, chunk_id string, resolution_id string, page long, score double, retriever string, run_at timestamp").write.parquet(f"{path}/rankings.parquet")
    spark.createDataFrame([(q, r) for q in range(12) for r in (f"d{q}", f"e{q}")], "query_id int, resolution_id string").write.parquet(f"{path}/qrels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("small"), "pqr", 5, lambda f, c: {"p": (0, 1)[c % 2], "q": 0.5, "r": 0.3}[f])


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("many"), "pq", 1200, lambda f, c: 0.1)


def loop(spark, d, metric):
    """family, pair, mean, p, adjusted, reject by a bootstrap of each pair."""
    s = metrics.per_query(metrics.cleaned(spark.read.parquet(f"{d}/rankings.parquet")), spark.read.parquet(f"{d}/qrels.parquet"), (5, 10)).collect()
    by = {}
    for r in s:
        by.setdefault(r["combination_id"], {})[r["query_id"]] = r[metric]
    rows = [(f"{a[0]}:{a} vs {b}", q, round(by[a][q] - by[b][q], 6)) for a, b in itertools.combinations(sorted(by), 2) if a[0] == b[0] for q in by[a]]
    df = spark.createDataFrame(rows, "pair string, query_id int, diff double")
    boot = stats.bootstrap(df, "pair", "query_id", "diff", N_BOOT).withColumn("family", F.split("pair", ":")[0])
    return stats.holm(boot, ["family"], "pair", "p")


def same(got, want, columns):
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(got) == rows(want)
    return rows(want)


def test_tested_is_the_bootstrap_of_each_difference():
    rnd = np.random.default_rng(3)
    for n in (1, 7, 2600):  # beyond 2,000 items a sum of one millionth has a mean that is rounded to 0
        x, y = (np.round(rnd.choice([0, 0, 1e-6, 0.333333, 0.5, 1], (k, n)), 6) for k in (4, 3))
        x[1], y[2] = x[0], x[0]
        y[1] = x[2] + 1e-6 * (np.arange(n) == 0)
        mean, p = stats.tested(x, y, 300)
        for i, j in np.ndindex(mean.shape):
            d = stats.away(x[i] - y[j], 6)
            m = stats.resampled_means(d, 300)
            assert (mean[i, j], p[i, j]) == (stats.away(d.mean(), 6), stats.away(min(1.0, 2 * min((m <= 0).mean(), (m >= 0).mean())), 6))


def test_every_pair_comes_once_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 3)
    rows = [(g, f"k{i}", q, float((i * 7 + q * q * (i % 5)) % 11)) for g, n in (("a", 8), ("b", 3), ("c", 1)) for i in range(n) for q in range(6)]
    rows += [("a", None, 1, 1.0), (None, "k1", 1, 1.0), ("a", "k1", None, 1.0)]
    dealt = stats.blocks(spark.createDataFrame(rows, "g string, k string, q int, v double"), "g", "k", "q", "v")
    figures = stats.paired(dealt, "g", "k", ["s", "d"], lambda x, y: [x @ y.T, x[:, :1] - y[:, 0]])
    v = {}
    for g, k, q, x in rows:
        if None not in (g, k, q):
            v.setdefault((g, k), []).append(x)
    want = sorted((g, a, b, float(np.dot(v[g, a], v[g, b])), v[g, a][0] - v[g, b][0]) for (g, a), (h, b) in itertools.combinations(sorted(v), 2) if g == h)
    assert sorted(map(tuple, stats.pairs(figures, dealt, "g", "k", ["s", "d"]).select("g", "a", "b", "s", "d").collect())) == want and len(want) == 28 + 3


def test_holm_levels(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.choice("ab"), f"k{i}", rnd.choice([0.0, 0.001, 0.01, 0.02, 0.3, 1.0])) for i in range(60)], "f string, k string, p double")
    levels = stats.holm_levels(df.groupBy("f", "p").agg(F.count("*").alias("n")), "f", "p", "n")
    same(df.join(levels, ["f", "p"]), stats.holm(df, ["f"], "k", "p"), ["f", "k", "p", "adjusted", "reject"])


def test_decision_rule(spark, small, many):
    cells = loop(spark, small, "recall_10").groupBy("family").agg(F.collect_list(F.struct(F.col("mean").alias("diff"), F.col("reject").alias("significant"))).alias("c"))
    want = cells.select("family", F.size("c").alias("n"), audits.decision(F.col("c"), 0.05).alias("verdict"))
    assert {r[2] for r in same(e.queries()["decision_rule"](spark, small), want, ["family", "n", "verdict"])} == {"STOP"}
    began = time.time()
    assert {r["n"] for r in e.queries()["decision_rule"](spark, many).collect()} == {1200 * 1199 // 2}
    assert time.time() - began < 100


def test_family_comparisons(spark, small, many):
    same(e.queries()["family_comparisons"](spark, small), loop(spark, small, "recall_10"), ["family", "pair", "mean", "p", "adjusted"])
    began = time.time()
    assert e.queries()["family_comparisons"](spark, many).select("pair").distinct().count() == 1200 * 1199
    assert time.time() - began < 100


def test_report_changes(spark, small, many):
    # by nDCG, which counts the rank of a hit, other differences and other verdicts than by recall
    made = lambda m: loop(spark, small, m).select("pair", F.col("mean").alias("diff"), F.col("reject").alias("significant"))
    want = audits.verdict_flips(made("recall_10"), made("ndcg_10"), "pair")
    assert len(same(e.queries()["report_changes"](spark, small), want, ["pair", "change", "old", "new"])) > 5
    began = time.time()
    e.queries()["report_changes"](spark, many).count()
    assert time.time() - began < 100


def test_pearson(spark, small):
    s = metrics.per_query(metrics.cleaned(spark.read.parquet(f"{small}/rankings.parquet")), spark.read.parquet(f"{small}/qrels.parquet"), (5, 10)).orderBy("query_id").collect()
    by = {}
    for r in s:
        by.setdefault(r["combination_id"], []).append(r["ndcg_10"])
    varied = sorted(c for c, v in by.items() if min(v) < max(v))
    want = [(a, b, pytest.approx(np.corrcoef(by[a], by[b])[0, 1], abs=6e-6)) for a, b in itertools.combinations(varied, 2)]
    got = e.queries()["pearson"](spark, small)
    assert sorted(map(tuple, got.select("a", "b", "pearson").collect())) == want and 0 < len(varied) < len(by)


def test_pearson_joins_no_rows_of_scores(spark, many):
    # 2,400 combinations: a join by query makes 12 rows of each of 2.9 million pairs
    plan = e.queries()["pearson"](spark, many)._jdf.queryExecution().optimizedPlan().toString()
    assert "query_id" not in plan
