"""Tests and effect sizes that compare two groups, as columns over aggregates."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A published fit of the complementary error function (relative error below 1.2e-7), highest power first.
ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368]
ERFC_SHIFT = -1.26551223


def erfc(x: Column) -> Column:
    """For x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + x / F.lit(2.0))
    s = F.lit(0.0)
    for c in ERFC:
        s = t * (F.lit(c) + s)
    return t * F.exp(-x * x + F.lit(ERFC_SHIFT) + s)


def erfc_sql(x: str) -> str:
    t, s = f"(1.0::DOUBLE / (1.0 + ({x}) / 2.0))", "0.0::DOUBLE"
    for c in ERFC:
        s = f"{t} * ({c}::DOUBLE + {s})"
    return f"({t} * exp(-({x}) * ({x}) + {ERFC_SHIFT} + {s}))"


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-squared of the table (a, b; c, d) with Yates's correction; null if a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n, margins = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    gap = F.greatest(F.abs(a * d - b * c) - n / F.lit(2.0), F.lit(0.0))
    return F.try_divide(n * gap * gap, margins)


def chi2_p(chi2: Column) -> Column:
    return erfc(F.sqrt(chi2 / F.lit(2.0)))


def cramers_v(chi2: Column, n: Column) -> Column:
    return F.sqrt(F.try_divide(chi2, n.cast("double")))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad / bc; infinite if b or c is 0."""
    return F.when((b == 0) | (c == 0), F.lit(float("inf"))).otherwise(F.try_divide((a * d).cast("double"), (b * c).cast("double")))


def _log_factorial(n: Column) -> Column:
    """log n!, by Stirling's series above 32 (error below 1e-15 of it)."""
    n = n.cast("bigint")
    x = n.cast("double") + F.lit(1.0)
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x**5)
    small = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(n > 32, series).otherwise(small)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided: the probability of all tables with these margins that are no likelier than (a, b; c, d).

    Only tables within 40 deviations of the likeliest one are summed up: all others together add less than 1e-300.
    """
    a, b, c, d = (x.cast("bigint") for x in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    n = (r1 + r2).cast("double")
    base = _log_factorial(r1) + _log_factorial(r2) + _log_factorial(c1) + _log_factorial(b + d) - _log_factorial(r1 + r2)
    chance = lambda x: F.exp(base - _log_factorial(x) - _log_factorial(r1 - x) - _log_factorial(c1 - x) - _log_factorial(r2 - c1 + x))
    mean = F.coalesce(F.try_divide(r1.cast("double") * c1, n), F.lit(0.0))
    wide = 40 * F.sqrt(F.coalesce(F.try_divide(mean * F.try_divide(r2.cast("double"), n) * (b + d), F.greatest(n - 1, F.lit(1.0))), F.lit(0.0))) + 50
    lo = F.greatest(F.lit(0).cast("bigint"), c1 - r2, F.floor(mean - wide).cast("bigint"))
    hi = F.least(r1, c1, F.ceil(mean + wide).cast("bigint"))
    seen = chance(a)
    tails = F.aggregate(F.filter(F.transform(F.sequence(lo, hi), chance), lambda p: p <= seen * (1 + 1e-7)), F.lit(0.0), lambda s, p: s + p)
    return F.least(F.lit(1.0), F.greatest(tails, seen))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def size_of_d(d: Column) -> Column:
    d = F.abs(d)
    return F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")


def size_of_v(v: Column) -> Column:
    return F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")


#: The values of a key are ranked within so many stretches, about.
STRETCHES = 64


def running_counts(values: DataFrame, by: list[str], x: str, n: str) -> DataFrame:
    """values (one row for each by and x) and upto: the sum of n over all x up to this one, for each by.

    A key's values are cut at quantiles into STRETCHES; sums run within these, so no task has to hold a key.
    """
    cuts = values.groupBy(*by).agg(F.percentile_approx(x, [i / STRETCHES for i in range(1, STRETCHES)], 1000).alias("__cuts"))
    v = values.join(cuts, by).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(x)))).drop("__cuts")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = v.groupBy(*by, "__part").agg(F.sum(n).alias("__m")).select(*by, "__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__first"))
    here = Window.partitionBy(*by, "__part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("upto", F.sum(n).over(here)).join(firsts, [*by, "__part"]).withColumn("upto", F.col("upto") + F.col("__first")).drop("__part", "__first")


def midranks(df: DataFrame, x: str, by: list[str], out: str = "rank") -> DataFrame:
    """df and the mean rank of x among the rows of its by. Distinct values are counted first, so only those are put in order, not rows."""
    values = running_counts(df.groupBy(*by, x).agg(F.count("*").alias("__n")), by, x, "__n")
    values = values.withColumn(out, F.col("upto") - (F.col("__n") - F.lit(1.0)) / F.lit(2.0)).withColumn("__ties", F.col("__n"))
    return df.join(values.drop("__n", "upto"), [*by, x])


#: The exact p is taken where one side has so many values at most and none is tied.
SMALL = 8


@lru_cache(maxsize=SMALL)
def _orders_up_to(m: int) -> list[list[int]]:
    """For each remainder of u by L = lcm(1..m): the differences by which the number of ways to write some t <= u as a sum of parts from 1..m goes on from u to u + L.

    That number is a polynomial of degree m in u along each remainder, so m + 1 values give all.
    """
    period = math.lcm(*range(1, m + 1))
    ways = [1] * (period * (m + 1))  # with the part 1 twice: the sum up to u
    for part in range(1, m + 1):
        for u in range(part, len(ways)):
            ways[u] += ways[u - part]
    out = []
    for r in range(period):
        row, differences = ways[r::period], []
        while row:
            differences.append(row[0])
            row = [b - a for a, b in zip(row, row[1:])]
        out.append(differences)
    return out


def orders_with_u_up_to(u: int, m: int, n: int) -> int:
    """In how many orders of m and n values (m is SMALL at most) U is u or less, exactly, however large n is.

    U is a sum of m parts of n at most. Without that bound the number is known by polynomials; of the sums with
    parts above n, those with one of n + 1, ..., n + m in the generating function are taken off, those with two put back.
    """
    total, tables = 0, _orders_up_to(m)
    for chosen in range(1 << m):
        over = [n + i + 1 for i in range(m) if chosen >> i & 1]
        left = u - sum(over)
        if left >= 0:
            k, r = divmod(left, len(tables))
            total += (-1) ** len(over) * sum(d * math.comb(k, j) for j, d in enumerate(tables[r]))
    return total


@F.pandas_udf(T.DoubleType())
def exact_u_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided p of U among n1 and n2 values without ties, one of the counts SMALL at most: twice the part of all orders whose U is as far out. A row a test comes here, no data."""
    def p(u: float, n1: float, n2: float) -> float | None:
        if pd.isna(u) or not 0 < min(n1, n2) <= SMALL:
            return None
        m, n, u = int(min(n1, n2)), int(max(n1, n2)), int(round(u))
        tail = orders_with_u_up_to(min(u, m * n - u), m, n)
        return min(1.0, float(Fraction(2 * tail, math.comb(m + n, m))))

    return pd.Series([p(*x) for x in zip(u, n1, n2)], dtype="float64")


def mann_whitney(df: DataFrame, x: str, first: Column, by: list[str]) -> DataFrame:
    """For each by: n1, n2, u1, p (two-sided), rank_biserial and greatest (of x), of the rows where first holds against the others.

    p is exact for small samples without ties (see SMALL), else normal, corrected for ties and continuity; where all
    values are equal it is 1. Null values don't count. Works on the counts of distinct values.
    """
    v = df.where(F.col(x).isNotNull()).withColumn("__f", first).groupBy(*by, x).agg(F.count_if("__f").alias("n1"), F.count("*").alias("n"))
    v = running_counts(v, by, x, "n")
    v = v.withColumn("rank", F.col("upto").cast("double") - (F.col("n") - 1).cast("double") / F.lit(2.0))
    n = F.col("n").cast("double")
    s = v.groupBy(*by).agg(F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n2"), F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum(n * n * n - n).alias("ties"), F.max(x).alias("greatest"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    s = s.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    z = F.greatest(F.try_divide(F.abs(F.col("u1") - n1 * n2 / 2) - F.lit(0.5), sd), F.lit(0.0))
    few = (F.col("ties") == 0) & (F.least(n1, n2) <= SMALL) & (F.least(n1, n2) > 0)
    p = F.when(few, exact_u_p("u1", n1, n2)).otherwise(F.least(F.lit(1.0), erfc(z / F.sqrt(F.lit(2.0)))))
    return s.select(*by, "n1", "n2", "u1", p.alias("p"), F.coalesce(F.try_divide(2 * F.col("u1"), n1 * n2) - 1, F.lit(0.0)).alias("rank_biserial"), "greatest")


def per_feature_tests(df: DataFrame, features: list[str], group: Column) -> DataFrame:
    """mann_whitney of each feature column, as rows with the feature's name; features that are 0 in all rows have null u1, p and rank_biserial."""
    long = df.withColumn("__g", group).unpivot("__g", features, "feature", "x")
    t = mann_whitney(long, "x", F.col("__g"), ["feature"])
    used = F.col("greatest") > 0
    return t.select("feature", "n1", "n2", *[F.when(used, F.col(c)).alias(c) for c in ("u1", "p", "rank_biserial")])


def cohens_d(x: Column, first: Column) -> Column:
    """An aggregate: the difference of means by the pooled deviation; 0 with fewer than two rows on a side or no deviation."""
    a, b = F.when(first, x), F.when(~first, x)
    na, nb = F.count(a).cast("double"), F.count(b).cast("double")
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2))
    return F.when((na < 2) | (nb < 2) | (pooled == 0), F.lit(0.0)).otherwise(F.try_divide(F.avg(a) - F.avg(b), pooled))


def cohens_d_simple(x: Column, first: Column) -> Column:
    """An aggregate: the difference of means by the root of the mean of both variances; 0 if there is no deviation."""
    a, b = F.when(first, x), F.when(~first, x)
    sd = F.sqrt((F.var_samp(a) + F.var_samp(b)) / F.lit(2.0))
    return F.when(sd > 0, (F.avg(a) - F.avg(b)) / sd).otherwise(F.lit(0.0))


def proportion_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's p where a side has fewer than 50 rows or a cell fewer than 5, else that of chi-squared."""
    few = (F.least(a + b, c + d) < 50) | (F.least(a, b, c, d) < 5)
    return F.when(few, fisher_p(a, b, c, d)).otherwise(chi2_p(chi2_yates(a, b, c, d)))


def proportion_test(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """test, p, effect_name and effect of the table (a, b; c, d): Fisher's with the odds ratio for small tables, else chi-squared with Cramer's V."""
    few = (F.least(a + b, c + d) < 50) | (F.least(a, b, c, d) < 5)
    return {
        "test": F.when(few, "Fisher's exact").otherwise("Chi-square"), "p": proportion_p(a, b, c, d), "effect_name": F.when(few, "OR").otherwise("V"),
        "effect": F.when(few, odds_ratio(a, b, c, d)).otherwise(cramers_v(chi2_yates(a, b, c, d), a + b + c + d)),
    }
