"""Readers that give tables their declared shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = False) -> DataFrame:
    """CSV with a header and quoted fields that may span lines (if lines, they don't: then large files are read in splits); empty fields are null."""
    return spark.read.option("header", True).option("multiLine", not lines).option("quote", '"').option("escape", '"').option("nullValue", "").schema(schema).csv(path)


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Just the columns of schema, cast: each the first non-null of itself and its synonyms, else its default."""
    defaults, synonyms = defaults or {}, synonyms or {}
    have = set(df.columns)
    cols = []
    for f in schema:
        found = [F.col(f"`{c}`") for c in [f.name, *synonyms.get(f.name, [])] if c in have]
        c = F.coalesce(*found, F.lit(defaults.get(f.name))) if found else F.lit(defaults.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def not_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those that earlier runs have stored."""
    return df.join(seen.select(key).distinct(), key, "left_anti")
