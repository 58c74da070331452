"""Quantiles, densities, components, frequent values and exact tests against plain computation."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlight.functions import distributions as D
from patchlight.functions import statistics as S

AT = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.77, "e": 1.0}


def plain(values, q):
    return float(np.quantile(np.array(values, float), q))


@pytest.mark.parametrize("small", [0, 50, 10**6])
def test_quantiles_of_odd_groups(spark, small):
    r = random.Random(2)
    groups = {
        "normal": [r.gauss(0, 1) for _ in range(700)], "heavy": [math.exp(r.gauss(0, 8)) for _ in range(601)], "ties": [float(r.choice([1, 1, 1, 2, 3])) for _ in range(500)], "equal": [4.5] * 300,
        "two": [1.0, 2.0], "one": [7.0], "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-310] * 20, "near": [1.0 + k * 2**-52 for k in range(60)], None: [float(k * k % 91) for k in range(400)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("empty", None)]
    r.shuffle(rows)
    got = {x.g: x for x in D.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], F.col("x"), AT, small).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g != "wide":
            assert all(got[g][n] == pytest.approx(plain(vs, q), rel=1e-12, abs=1e-300) for n, q in AT.items()), g
    assert [got["wide"][n] for n in "ace"] == [-1.7e308, 5e-324 if small < 100 else got["wide"]["c"], 1.7e308]


def test_quantiles_of_a_million_values_in_no_task(spark):
    """Two groups of which no exchange carries more than bins: rows are read, never shuffled."""
    df = spark.range(1_200_000).selectExpr("id % 2 AS g", "CAST(hash(id) AS double) / 7 AS x")
    found = D.quantiles(df, ["g"], F.col("x"), {"q": 0.5, "r": 0.9}, small=1000)
    want = {r.g: (r.q, r.r) for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("q"), F.percentile("x", F.lit(0.9)).alias("r")).collect()}
    got = {r.g: (r.q, r.r) for r in found.collect()}
    assert set(got) == {0, 1} and all(got[g] == pytest.approx(want[g]) for g in want)
    assert D.quantiles(df.where("g > 5"), ["g"], F.col("x"), {"q": 0.5}).collect() == []
    assert D.quantiles(df.limit(101), [], F.col("x"), {"q": 0.5}, small=10).count() == 1


@pytest.mark.parametrize("kind", ["continuous", "counts", "far"])
def test_density_against_the_sum_of_all_curves(spark, kind):
    r = np.random.default_rng(5)
    x = {"continuous": np.r_[r.normal(0, 1, 500), r.normal(6, 0.3, 300)], "counts": r.poisson(3, 900).astype(float), "far": np.r_[r.normal(0, 1, 400), [900.0]]}[kind]
    rows = [("g", float(v)) for v in x] + [("equal", 3.0)] * 4 + [("one", 1.0), (None, 1.0), (None, 2.0), ("g", None)]
    got = D.kernel_density(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], F.col("x")).collect()
    by = {}
    for t in got:
        by.setdefault(t.g, {})[t.place] = (t.at, t.density)
    assert {g: len(v) for g, v in by.items()} == {"g": 100, "equal": 100, "one": 100, None: 100}
    assert all(p == (3.0, 1.0) for p in by["equal"].values())
    h = x.std(ddof=1) * len(x) ** -0.2
    for i, at in enumerate(np.linspace(x.min(), x.max(), 100)):
        want = np.exp(-0.5 * ((at - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert by["g"][i] == (pytest.approx(at, abs=1e-9), pytest.approx(want, abs=1e-8))


def test_components_against_an_eigensolver(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (300, 6)) @ r.normal(0, 1, (6, 6)) + 1e6
    x[:, 3] = 5.0  # constant
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] + [0.0] * 5), (903, [float("nan")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
    of = D.principal_components(df, "v", 3)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 1e-6, sd, 1)
    values, axes = np.linalg.eigh(np.cov(z.T, bias=True))
    assert of.ratio == pytest.approx(values[::-1][:3] / values.sum(), abs=1e-9)
    for k in range(3):
        w = axes[:, ::-1][:, k]
        assert of.loadings[k] == pytest.approx(w * np.sign(w[np.abs(w).argmax()]), abs=1e-7)
    got = {t.id: t for t in df.where("id < 900").select("id", *[c.alias(f"c{i}") for i, c in enumerate(D.scores(df, "v", of))]).collect()}
    assert all(got[i].c0 == pytest.approx(float(z[i] @ of.loadings[0]), abs=1e-6) for i in range(300))


def test_frequent_values_are_complete_and_exact(spark):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), i, min(int(r.paretovariate(0.6)), 10**6), [1, i % 2], f"k{i % 40}") for i in range(8000)]
    df = spark.createDataFrame(rows, "s string, id int, z long, l array<int>, k string").repartition(16)
    got = {(t.name, t.value): t.n for t in D.frequent_values(df, 0.004).collect()}
    want = {}
    for j, name in enumerate(df.columns):
        for row in rows:
            v = row[j]
            v = None if v is None else f"[1,{v[1]}]" if name == "l" else str(v)
            want[name, v] = want.get((name, v), 0) + 1
    assert got == {k: n for k, n in want.items() if n > 32} and not any(name == "id" for name, _ in got)
    assert D.frequent_values(df.where("false")).collect() == []


def counts_of_u(m, n):
    """How many orders of m and n values have each U, by putting in the greatest value of either side."""
    ways = {(0, j): [1] for j in range(n + 1)} | {(i, 0): [1] for i in range(m + 1)}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            a, b = ways[i - 1, j], ways[i, j - 1]
            ways[i, j] = [(a[u - j] if 0 <= u - j < len(a) else 0) + (b[u] if u < len(b) else 0) for u in range(i * j + 1)]
    return ways[m, n]


@pytest.mark.parametrize("m,n", [(1, 1), (1, 40), (2, 3), (3, 3), (5, 17), (8, 8), (8, 60)])
def test_orders_by_u(m, n):
    sums = list(itertools.accumulate(counts_of_u(m, n)))
    assert [S.orders_with_u_up_to(u, m, n) for u in range(m * n + 1)] == sums and sums[-1] == math.comb(m + n, m)


def test_exact_p_of_eight_against_five_thousand(spark):
    """All orders, counted by a plain recurrence over the places of the eight, give the same p; much larger sides are no longer."""
    m, n = 8, 5000
    ways = np.zeros(m * n + 1, dtype=object)
    ways[0] = 1
    for i in range(1, m + 1):
        before = ways.copy()
        ways[n + i :] -= before[: -(n + i)]
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])
    u = 7321
    want = float(2 * sum(ways[: u + 1])) / math.comb(m + n, m)
    got = spark.createDataFrame([(float(u), 8.0, 5000.0), (float(m * n - u), 5000.0, 8.0), (3e9, 8.0, 1e9), (5.0, 20.0, 30.0), (None, 2.0, 2.0), (0.0, 0.0, 5.0)], "u double, a double, b double").select(S.exact_u_p("u", "a", "b").alias("p")).collect()
    assert [r.p for r in got[:2]] == pytest.approx([want, want], rel=1e-12)
    assert 0 < got[2].p < 1 and [r.p for r in got[3:]] == [None, None, None]


def test_mann_whitney_is_exact_for_few_against_many(spark):
    rows = [("g", i * 3 + 1.5, True) for i in range(6)] + [("g", float(i), False) for i in range(2000)]
    r = S.mann_whitney(spark.createDataFrame(rows, "k string, x double, f boolean"), "x", F.col("f"), ["k"]).first()
    u = sum(i * 3 + 2 for i in range(6))
    assert r.u1 == u and r.p == pytest.approx(2 * S.orders_with_u_up_to(u, 6, 2000) / math.comb(2006, 6), rel=1e-9)
