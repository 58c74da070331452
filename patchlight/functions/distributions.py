"""Distributions of large groups: exact quantiles by descent through bins, densities by binned counts, principal components from moments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of so many values at most are left to Spark's percentile(), which holds a group's distinct values in one task.
SMALL_GROUP = 1_000_000
#: Bins into which an interval of values is cut at a time.
BINS = 4096


def _usable(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    return df.select(*by, x.cast("double").alias("__x")).where("__x is not null and not isnan(__x)")


def quantiles(df: DataFrame, by: list[str], x: Column, at: dict[str, float], small: int = SMALL_GROUP) -> DataFrame:
    """For each by (null is one, too) with a value of x: a column for each name of at, the quantile of that part, interpolated. Nulls and NaN don't count; infinite values may not occur in groups above small.

    Of a group with more than `small` values, no task ever holds the values. The least and greatest value bound the interval
    that holds a rank; its values are counted in BINS (before anything is shuffled), and the search goes on in the bin that
    holds the rank, between the least and greatest value that are there, until these are equal. Each round reads the rows
    once for all groups, and takes three digits or more off the interval. The groups that need this are rows / small at
    most; their bounds are kept on the driver.
    """
    v = _usable(df, by, x)
    ends = v.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    large = ends.where(F.col("__n") > small).collect()
    exact = lambda rows: rows.groupBy(*by).agg(*[F.percentile("__x", F.lit(float(q))).alias(n) for n, q in at.items()])
    if not large:
        return exact(v)
    keys = v.select(*by).schema
    groups = df.sparkSession.createDataFrame([(*(r[c] for c in by), i) for i, r in enumerate(large)], T.StructType([*(T.StructField(f"__by_{f.name}", f.dataType) for f in keys), T.StructField("__g", T.IntegerType())]))
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by] or [F.lit(True)]
    of_large = v.join(F.broadcast(groups), same).select("__g", "__x")

    # ranks to find, counted from 0: of each the interval that still holds it, and its place among the values there
    wanted, found = {}, {}
    for g, r in enumerate(large):
        for q in at.values():
            for k in {math.floor(q * (r["__n"] - 1)), math.ceil(q * (r["__n"] - 1))}:
                wanted[g, k] = (r["__low"], r["__high"], k)
    while wanted:
        found |= {gk: low for gk, (low, high, _) in wanted.items() if low == high}
        wanted = {gk: w for gk, w in wanted.items() if gk not in found}
        if not wanted:
            break
        spans = {s: i for i, s in enumerate(sorted({(g, low, high) for (g, _), (low, high, _) in wanted.items()}))}
        of_span = df.sparkSession.createDataFrame([(g, i, low, high, 0.5 if math.isinf(high - low) else 1.0) for (g, low, high), i in spans.items()], "__g int, span int, low double, high double, scale double")
        ranks = df.sparkSession.createDataFrame([(spans[g, low, high], g, k, place) for (g, k), (low, high, place) in wanted.items()], "span int, g int, k long, place long")
        held = of_large.join(F.broadcast(of_span), "__g").where("__x between low and high")
        part = (F.col("__x") * F.col("scale") - F.col("low") * F.col("scale")) / (F.col("high") * F.col("scale") - F.col("low") * F.col("scale"))
        bins = held.groupBy("span", F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("span").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        hit = bins.withColumn("upto", upto).join(F.broadcast(ranks), "span").where("place >= upto - n and place < upto")
        for r in hit.select("g", "k", "low", "high", (F.col("place") - F.col("upto") + F.col("n")).alias("place")).collect():  # a row for each rank
            wanted[r["g"], r["k"]] = (r["low"], r["high"], r["place"])

    def value(g: int, n: int, q: float) -> float:
        a, b = math.floor(q * (n - 1)), math.ceil(q * (n - 1))
        return found[g, a] + (found[g, b] - found[g, a]) * (q * (n - 1) - a)

    names = T.StructType([*keys, *(T.StructField(n, T.DoubleType()) for n in at)])
    done = df.sparkSession.createDataFrame([(*(r[c] for c in by), *(value(g, r["__n"], q) for q in at.values())) for g, r in enumerate(large)], names)
    if not by:
        return done
    rest = v.join(F.broadcast(groups), same, "left_anti")
    return exact(rest).unionByName(done)


def kernel_density(df: DataFrame, by: list[str], x: Column, points: int = 100, fine: int = 512) -> DataFrame:
    """(by, place, at, density): for each by, `points` places from its least to its greatest value, and there the density of a sum of normal curves.

    Their deviation is that of the values times n ** -0.2. A group of equal values has density 1 at its value. Values are
    counted first, in bins a fine-th of the deviation wide, with their mean and spread in it; a bin then counts as one
    curve, widened by that spread, at the places within nine deviations. So no row is sent to any place, and a bin to
    `points` at most. Nulls and NaN don't count.
    """
    v = _usable(df, by, x)
    stats = v.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.coalesce(F.stddev_samp("__x"), F.lit(0.0)).alias("__sd"))
    stats = stats.withColumn("__h", F.when(F.col("__high") > F.col("__low"), F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))).withColumn("__step", (F.col("__high") - F.col("__low")) / F.lit(float(points - 1)))
    named = stats.select(*[F.col(c).alias(f"__by_{c}") for c in by], *[c for c in stats.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by] or [F.lit(True)]
    binned = v.join(named, same).where("__h is not null").withColumn("__d", F.col("__x") - F.col("__low"))
    # sums are of distances to the bin's middle, so that they lose no digits
    binned = binned.withColumn("__bin", F.floor(F.col("__d") / (F.col("__h") / fine))).withColumn("__off", F.col("__d") - (F.col("__bin") + 0.5) * (F.col("__h") / fine))
    facts = ["__n", "__h", "__step"]
    bins = binned.groupBy(*by, "__bin", *facts).agg(F.count("*").alias("__k"), F.avg("__off").alias("__mean"), F.avg(F.col("__off") * F.col("__off")).alias("__square"))
    bins = bins.withColumns({"__c": (F.col("__bin") + 0.5) * (F.col("__h") / fine) + F.col("__mean"), "__var": F.greatest(F.col("__square") - F.col("__mean") * F.col("__mean"), F.lit(0.0)) / (F.col("__h") * F.col("__h"))})
    reach = 9 * F.col("__h")
    first, last = F.greatest(F.ceil((F.col("__c") - reach) / F.col("__step")), F.lit(0)), F.least(F.floor((F.col("__c") + reach) / F.col("__step")), F.lit(points - 1))
    spread = bins.where(first <= last).withColumn("place", F.explode(F.sequence(first, last)))
    u = (F.col("place") * F.col("__step") - F.col("__c")) / F.col("__h")
    curve = F.exp(-u * u / 2) * (1 + F.col("__var") * (u * u - 1) / 2) * F.col("__k") / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi))
    sums = spread.groupBy(*by, F.col("place").cast("int").alias("place")).agg(F.sum(curve).alias("density"))
    grid = stats.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    sums = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("place").alias("__place"), "density")
    out = grid.join(sums, [*same, F.col("place") == F.col("__place")], "left")
    return out.select(*by, "place", (F.col("__low") + F.col("place") * F.col("__step")).alias("at"), F.when(F.col("__h").isNull(), 1.0).otherwise(F.coalesce("density", F.lit(0.0))).alias("density"))


class Components(NamedTuple):
    mean: np.ndarray
    deviation: np.ndarray  #: of the population; 1 for columns that are constant
    loadings: np.ndarray  #: a row for each component
    ratio: np.ndarray  #: the part of the variance that each explains


def principal_components(vectors: DataFrame, column: str, k: int) -> Components:
    """The first k components of standardised vectors (arrays of one size; others, and those with nulls or NaN, are left out).

    Means and products are summed in one pass: each task gives the sums of its rows, less the first row's values so that
    few digits cancel out; their number is that of the columns squared, however many rows there are. Of each component
    the loading that is farthest from 0 (the first of these) is positive.
    """
    first = vectors.where(F.col(column).isNotNull()).select(column).first()
    if first is None:
        raise ValueError("no vectors")
    pivot = np.nan_to_num(np.array([0.0 if v is None else v for v in first[0]]))
    d = len(pivot)
    usable = vectors.where((F.size(column) == d) & F.forall(F.col(column).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v)))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((d + 1, d + 1))
        for b in batches:
            z = np.ones((len(b), d + 1))
            z[:, :d] = b.column(0).flatten().to_numpy().reshape(len(b), d) - pivot
            sums += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["cell", "total"])

    found = usable.select(F.col(column).cast("array<double>")).mapInArrow(summed, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()  # (d + 1) ** 2 rows
    sums = np.zeros((d + 1) ** 2)
    for r in found:
        sums[r["cell"]] = r["total"]
    sums = sums.reshape(d + 1, d + 1)
    n = sums[d, d]
    mean = sums[d, :d] / n
    cov = sums[:d, :d] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(cov), 0))
    deviation[deviation <= 1e-12 * np.maximum(np.abs(mean + pivot), 1e-300)] = 0
    scale = np.where(deviation > 0, deviation, 1.0)
    correlation = cov / np.outer(scale, scale)
    correlation[deviation == 0] = correlation[:, deviation == 0] = 0
    values, axes = np.linalg.eigh(correlation)
    values, axes = values[::-1][:k], axes.T[::-1][:k]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).round(12).argmax(1)])
    return Components(mean + pivot, scale, axes * signs[:, None], values / max(np.trace(correlation), 1e-300))


def scores(vectors: DataFrame, column: str, of: Components) -> list[Column]:
    """A column for each component: the standardised vector's sum of products with its loadings."""
    x, out = F.col(column).cast("array<double>"), []
    for row in of.loadings:
        by, shift = row / of.deviation, float((row * of.mean / of.deviation).sum())
        products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in by]), lambda a, w: a * w)
        out.append(F.aggregate(products, F.lit(0.0), lambda s, v: s + v) - F.lit(shift))
    return out


class _Frequent:
    """Candidates for the values that more than one in `capacity` of all rows have: counters that are taken down together when there are too many."""

    def __init__(self, capacity: int):
        self.capacity, self.counts = capacity, {}

    def add(self, values: list, counts: list) -> None:
        for v, n in zip(values, counts):
            self.counts[v] = self.counts.get(v, 0) + n
        if len(self.counts) > 8 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.capacity:
            less = sorted(self.counts.values(), reverse=True)[self.capacity]
            self.counts = {v: n - less for v, n in self.counts.items() if n > less}


def frequent_values(df: DataFrame, share: float = 0.01) -> DataFrame:
    """(name, value, n): for each column of df the values (as text; null for null) that more than this share of the rows have, counted exactly.

    Two passes for all columns together. In the first, tasks keep 1 / share counters a column, as do the tasks that put these
    together; whatever is that frequent is among them at the end. The second counts just those, before anything is
    shuffled. Columns of arrays, maps and structs are taken as JSON.
    """
    names, capacity = df.columns, max(1, math.ceil(1 / share))
    simple = lambda t: not isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    text = lambda f: F.col(f"`{f.name}`").cast("string") if simple(f.dataType) else F.base64(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.BinaryType) else F.to_json(F.col(f"`{f.name}`"))
    texts = df.select(*[text(f).alias(f"c{i}") for i, f in enumerate(df.schema)])

    def give(kept: list[_Frequent]) -> pa.RecordBatch:
        rows = [(i, v, n) for i, k in enumerate(kept) for v, n in k.counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.string(), pa.int64()))], ["c", "value", "n"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [_Frequent(capacity) for _ in names]
        for b in batches:
            for k, column in zip(kept, b.columns):
                counted = column.value_counts()
                k.add(counted.field("values").to_pylist(), counted.field("counts").to_pylist())
        for k in kept:
            k.shrink()
        yield give(kept)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [_Frequent(capacity) for _ in names]
        for b in batches:
            for i, v, n in zip(*(b.column(j).to_pylist() for j in range(3))):
                kept[i].add([v], [n])
        for k in kept:
            k.shrink()
        yield give(kept)

    shape = "c int, value string, n long"
    # a column's counters come together in one task: capacity of them from each task
    candidates = texts.mapInArrow(local, shape).repartition("c").mapInArrow(merged, shape).select("c", "value").collect()  # capacity rows a column at most
    sets = [[r["value"] for r in candidates if r["c"] == i] for i in range(len(names))]
    of = df.sparkSession.createDataFrame([(i, v) for i, vs in enumerate(sets) for v in vs], "c int, value string")
    # each row gives its columns' values that are candidates; summed by task first
    cells = texts.select(F.posexplode(F.array(*texts.columns)).alias("c", "value"))
    counted = cells.join(F.broadcast(of.select(F.col("c").alias("oc"), F.col("value").alias("ov"))), (F.col("c") == F.col("oc")) & F.col("value").eqNullSafe(F.col("ov"))).groupBy("c", "value").agg(F.count("*").alias("n"))
    total = texts.count()
    name = F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1)
    return counted.where(F.col("n") > share * total).select(name.alias("name"), "value", "n")
