"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm.common import md5_bits, unused

#: Each shard's rows are numbered within so many parts, so that no task has to hold a shard.
PARTS = 4096
BROADCAST_ROWS = 1_000_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 and up) with the least -ln(u) / weight, u drawn in (0, 1) by the key and the shard's number alone.

    A shard that is added can only win keys for itself; a shard's weight is its expected share of keys.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct((-F.log((md5_bits(F.concat(key, F.lit(f"/{j}")), 1, 13) + F.lit(0.5)) / F.lit(2.0**52)) / F.lit(float(w))).alias("s"), F.lit(j).alias("j")) for j, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))["j"].cast("int")


def shard(docs: DataFrame, n_shards: int = 8, weights: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, and columns size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1. slot: place in the shard, without gaps from 0, ordered by hash of the key, key,
    text_crc32 and size. grown_shard: the shard under n_shards + 1 shards (the new one has the mean weight).
    A null key hashes as an empty one; a null text has no bytes (crc 0, size 1). Repeated rows share a shard and get
    slots of their own; which of two equal rows comes first doesn't show. Existing columns of these names are replaced.
    """
    weights = list(weights or [1.0] * n_shards)
    grown = [*weights, sum(weights) / len(weights)]
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    part, n, first, at = (unused(x, docs) for x in ("part", "n", "first", "at"))
    placed = {"shard": rendezvous(F.col(key), weights), part: md5_bits(F.coalesce(F.col(key).cast("string"), F.lit("")), 14, 3)}
    # at most n_shards * PARTS rows, however many documents: sent to every task up to BROADCAST_ROWS
    firsts = docs.select(key).withColumns(placed).groupBy("shard", part).agg(F.count("*").alias(n))
    firsts = firsts.withColumn(first, F.coalesce(F.sum(n).over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    rows = docs.withColumns(placed | {
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1,
        "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit(""))),
        "law": F.lit("key"),
        "grown_shard": rendezvous(F.col(key), grown),
    })
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy("shard", part).orderBy(key, "text_crc32", "size")))
    return rows.join(F.broadcast(firsts) if len(weights) * PARTS <= BROADCAST_ROWS else firsts, ["shard", part], "left").withColumn("slot", F.col(first) + F.col(at) - 1).drop(part, at, first)


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: CRC-32 isn't in DuckDB: here it runs byte by byte over a table of the 256 remainders.
ORACLE_SQL = """
WITH steps AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(cast(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS hx FROM documents
), u AS (
  SELECT rid, j, -ln((('0x' || substr(md5(k || '/' || j), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS s FROM d, range(9) r(j)
), a AS (
  SELECT rid, arg_min(j, s) FILTER (WHERE j < 8) AS shard, arg_min(j, s) AS grown FROM u GROUP BY rid
), c AS (
  SELECT d.*, a.shard, a.grown, length(hx) // 2 + 1 AS size, ('0x' || substr(md5(k), 14, 3))::BIGINT AS part,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295) AS crc
  FROM d JOIN a USING (rid), steps
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, grown::INT AS grown_shard FROM c
"""
