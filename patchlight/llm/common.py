"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (in local tests) a new temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(named)
    return named


#: The folders that the innermost open scratch() deletes; each thread, and so each query, has its own.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_folder(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder. Within a scratch() it lasts as long as that, unless keep; else the caller's cluster clears it."""
    path, held = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", _scratch.get()
    if held is not None and not keep:
        held.append(path)
    return path


def materialise(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """df, written as Parquet to a scratch_folder() and read again: cuts the lineage and outlives executors."""
    path = scratch_folder(df.sparkSession, name, keep)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised within is deleted at the end, but for what is to be kept: no later result may read it."""
    held = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _scratch.reset(held)


def unused(name: str, *dfs: DataFrame) -> str:
    """name, with as many lines before it as it takes to be no column's, in any case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same on text that is all ASCII, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def md5_bits(text: Column, start: int, digits: int) -> Column:
    """The number that some hex digits of a text's MD5 spell (start counts from 1; up to 15 digits)."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def sorted_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Of batches whose rows come sorted by some columns of numbers: one table for each run of equal ones, also where a run spans batches."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        c = np.stack([t.column(n).to_numpy() for n in by], 1)
        cuts = [0, *(np.flatnonzero((c[1:] != c[:-1]).any(1)) + 1)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield t.slice(lo, hi - lo)
        held = t.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the least that links (a, b), given in both directions, reach from it."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of the graph of links (a, b): root is the least node that can be reached. Nodes without links have no row.

    Alternates large and small stars (every node points its greater, then its smaller neighbours at the least one) until
    nothing changes: about as many rounds as the logarithm of the longest path. Each round is written out, so lost
    executors cost at most one round, and no node's neighbours ever meet in one task: minima are taken by partial
    aggregation and joined back.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, name)

    def star(pairs: DataFrame, least: DataFrame) -> DataFrame:
        # written out first, both sides of the join are plain shuffles, of which Spark splits those of a hot node
        joined = pairs.join(materialise(least, f"{name}-least"), "u")
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = star(both.where("v > u"), least).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = star(large, least).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        new = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        same = new.unionByName(edges).groupBy("u", "v").agg(F.count("*").alias("n")).where("n = 1").limit(1)
        if not same.take(1):
            break
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
