"""Sinks, and readers of what sinks or recorded requests left in files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder spark.checkpoint.dir; where it is unset (local tests), in a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-files-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to a fresh_folder() and read again: for what a plan reads more than once."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nested(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: of each part with columns k and v a map, of others (one row each) a struct. For summaries: parts have few rows."""
    out = None
    for name, df in parts.items():
        if df.columns == ["k", "v"]:
            one = df.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))
        else:
            one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that df has."""
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header, quotes doubled, spaces kept: csv() reads the same rows back, but empty texts as null."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def probe(df: DataFrame) -> DataFrame:
    """One row for each column of df: its type, the number of rows and of non-null values."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.col("__rows").alias("rows"), F.col(f"`{c}`").alias("filled")) for c, t in df.dtypes]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def report(df: DataFrame) -> Column:
    """A row of df as a row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))


def write_json(df: DataFrame, path: str) -> None:
    """A line of JSON for each row, nulls included."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_markdown(df: DataFrame, path: str, order: list[str]) -> None:
    """A report's few rows, in order, as one file with a table of Markdown."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = df.select(F.struct(F.lit(1).alias("part"), *order).alias("at"), report(df).alias("value"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("rows"))
    one.select(F.explode(F.concat(F.array(*map(F.lit, head)), F.transform("rows", lambda r: r["value"]))).alias("value")).write.text(path)
