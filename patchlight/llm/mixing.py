"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlight.llm.common import materialise, md5_bits

WORD = r"[^\x20\x09-\x0D]+"
#: (sqrt(5) - 1) / 2: multiples of it, mod 1, fill the unit interval evenly at every length.
GOLDEN = 0.6180339887498949
MOST_REPEATS = 3
#: A source's documents are shuffled and laid end to end within so many parts, and slots ranked within so many at a time.
PARTS, CHUNK = 4096, 4096
#: Cells of the unit interval by which points find their source.
CELLS = 4096


class Mix(NamedTuple):
    sources: DataFrame  #: source, source_no, weight, source_size, target, quota (words to take), blocks, slots
    slots: DataFrame  #: source_no, slot (order in the mix), block, words (of the block's first words that are taken)
    documents: DataFrame  #: the input's rows: doc_id, size, source_no, start (in the source's shuffled words), taken, slots (in which its words begin: one for each time that it is taken)


def targets(per_source: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Of (source, source_size): source_no by code point (null last), weight, target.

    Targets share the sum of all sizes by weight, none above MOST_REPEATS times its source's size; what that cuts off is
    shared again by weight. In order of limit / weight, a source is cut off if its limit is at most what its weight would
    get of what the ones before leave; one ordered pass finds all. Holds one row for each source.
    """
    by_name, by_limit = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("__r", "source_no")
    before, all_rows = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = per_source.withColumn("source_no", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("source_no") % len(cycle) + 1).cast("int")))
    s = s.withColumn("__limit", F.col("source_size") * MOST_REPEATS).withColumn("__r", F.col("__limit").cast("double") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("__limit").over(before), F.lit(0))
    s = s.withColumn("__share", left.cast("double") / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("__free", F.min(F.when(F.col("__r") > F.col("__share"), F.struct("__r", "source_no", "__share"))).over(all_rows)["__share"])
    free = F.col("__r") > F.coalesce(F.col("__free"), F.lit(0.0))
    return s.withColumn("target", F.when(free & F.col("__free").isNotNull(), F.col("__free") * F.col("weight")).otherwise(F.col("__limit").cast("double"))).drop("__limit", "__r", "__share", "__free")


def mix(docs: DataFrame, block_words: int = 512, cycle: tuple[int, ...] = (1, 2, 3), key: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """The mix as a schedule of blocks of block_words words.

    Each source's documents, in the order of the MD5 of their keys, make one sequence of words, cut into blocks. Slot k of
    the mix belongs to the source into whose stretch of the unit interval (as long as its part of all slots) the fraction
    of (k + 1/2) * GOLDEN falls. A source's r-th slot takes its r-th block, beginning again after the last one, until its
    quota (its target, rounded) is met; slots still missing at the end of the schedule (a few at most) follow it.
    No word is taken more than MOST_REPEATS times. Null or empty texts have no words and are never taken; null keys hash
    as empty ones; rows that share a key follow each other by size. No source, or only empty ones: no slots.
    """
    spark, b = docs.sparkSession, block_words
    rows = materialise(docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"),
    ), "mix-rows")
    rows = rows.withColumn("part", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    parts = materialise(rows.groupBy("source", "part").agg(F.sum("size").alias("n")), "mix-parts")
    s = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), cycle)
    n, q = F.col("source_size"), F.col("quota")
    s = s.withColumn("quota", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(n / b))
    s = s.withColumn("slots", F.when(n > 0, F.floor(q / n) * F.col("blocks") + F.ceil((q % n) / b)).otherwise(F.lit(0)))
    s = s.withColumn("after", F.coalesce(F.sum("slots").over(Window.orderBy("source_no")), F.lit(0)))
    s = materialise(s, "mix-sources")
    total = s.agg(F.max("after")).first()[0] or 0

    cuts = s.select("source_no", ((F.col("after") - F.col("slots")) / F.lit(float(max(total, 1)))).alias("lo"), (F.col("after") / F.lit(float(max(total, 1)))).alias("hi")).where("hi > lo")
    cuts = cuts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    x = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(total).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(cuts, "cell").where("u >= lo and u < hi").select("slot", "source_no", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(counts.drop("n"), ["source_no", "chunk"]).select("source_no", "slot", (F.col("r") + F.col("before")).alias("r"))
    had = s.select("source_no", "slots").join(counts.groupBy("source_no").agg(F.sum("n").alias("had")), "source_no", "left")
    missing = had.withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots").select("source_no", F.lit(total).alias("slot"), F.explode(F.sequence("had", F.col("slots") - 1)).alias("r"))
    about = s.where("slots > 0").select("source_no", "source_size", "quota", "blocks", "slots")
    slots = ranked.unionByName(missing).join(about, "source_no").where(F.col("r") < F.col("slots"))
    slots = slots.withColumn("block", (F.col("r") % F.col("blocks")).cast("bigint")).withColumn("turn", F.floor(F.col("r") / F.col("blocks")))
    at = F.col("block") * b
    slots = slots.withColumn("words", F.least(F.lit(b), n - at, q - F.col("turn") * n - at)).select("source_no", "slot", "block", "words")

    starts = parts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(s.select(F.col("source").alias("__s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "n")
    here = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("at", F.coalesce(F.sum("size").over(here), F.lit(0))).alias("l")
    laid = laid.join(starts.alias("f"), (F.col("l.part") == F.col("f.part")) & F.col("l.source").eqNullSafe(F.col("f.source")))
    laid = laid.select("doc_id", "size", "source_no", "source_size", "target", (F.col("at") + F.col("first")).alias("start"))
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    pieces = pieces.withColumn("from", F.greatest(F.col("start") - F.col("block") * b, F.lit(0))).withColumn("to", F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b)))
    # a block has a slot each time that its source begins again: MOST_REPEATS at most
    per_block = slots.groupBy("source_no", "block", "words").agg(F.count("*").alias("times"), F.collect_list("slot").alias("of"))
    overlap = F.greatest(F.least("to", "words") - F.col("from"), F.lit(0)) * F.col("times")
    whole = ["doc_id", "size", "source_no", "source_size", "target", "start"]
    begins = F.when((F.col("start") >= F.col("block") * b) & (overlap > 0), F.col("of"))
    taken = pieces.join(per_block, ["source_no", "block"], "left").groupBy(*whole).agg(F.coalesce(F.sum(overlap), F.lit(0)).alias("taken"), F.array_sort(F.flatten(F.collect_list(begins))).alias("slots"))
    return Mix(s, slots, taken.unionByName(laid.where("size = 0").withColumns({"taken": F.lit(0).cast("bigint"), "slots": F.array().cast("array<bigint>")})))


def digest(mixed: Mix) -> DataFrame:
    """slots: the places of the schedule in which the document's words begin, comma-joined; none if it isn't taken."""
    return mixed.documents.select("doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"), F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"))


def apply(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs as the mix has them, in the order of its slots: each as often as its blocks take it whole, and once more cut off after the words that they take besides.

    So each source has its quota of words, exactly. Quotas end within one document a source; only that one is cut (and its
    column chars, if there is one, set anew). Rows that share a key and a size, equal ones too, share what is taken of them
    evenly, to the word. Documents without words, with null texts too, are in no block and go. Null keys and sources count
    as any others; other columns stay, whatever their names; an empty table stays empty. A document's turn comes with the
    slot in which its words begin, each time that it is taken: partitions hold ranges of slots, and their rows are in order,
    so every stretch of the corpus as it is written has its sources near their weights.
    """
    columns = docs.columns
    n = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    source = [F.col("`source`")] if "source" in columns else [F.lit(None).cast("string")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("d"), F.col(f"`{key}`").alias("id"), n.alias("n"), F.col(f"`{text}`").alias("t"), source[0].alias("s"))
    mixed = mix(docs)
    taken = mixed.documents.where("taken > 0").join(mixed.sources.select("source_no", "source"), "source_no")
    shares = taken.groupBy(F.col("doc_id").alias("k"), F.col("size").alias("z"), F.col("source").alias("o")).agg(F.sum("taken").alias("words"), F.count("*").alias("rows"), *[F.min(F.get("slots", F.lit(i))).alias(f"slot{i}") for i in range(MOST_REPEATS)])
    j = rows.join(shares, F.col("id").eqNullSafe(F.col("k")) & (F.col("n") == F.col("z")) & F.col("s").eqNullSafe(F.col("o")))
    # mean whole copies and words over of a row; what doesn't come out even goes to the cut
    words = F.floor(F.col("words") / F.col("rows"))
    j = j.select("d", "n", "t", F.array(*[f"slot{i}" for i in range(MOST_REPEATS)]).alias("slots"), F.floor(words / F.col("n")).cast("int").alias("whole"), (words % F.col("n")).cast("int").alias("over"))
    j = j.select("*", F.posexplode(F.concat(F.array_repeat(F.lit(False), F.col("whole")), F.when(F.col("over") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))).alias("nth", "cut"))
    # rows that share what is taken of them may be taken once more than a slot is theirs: they follow the last one
    j = j.withColumn("slot", F.coalesce(F.get("slots", F.col("nth")), F.array_max("slots")))
    j = j.repartitionByRange("slot", F.xxhash64("id", "nth")).sortWithinPartitions("slot", F.xxhash64("id", "nth"), "nth")
    first = F.array_join(F.slice(F.regexp_extract_all("t", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("over")), "")
    j = j.withColumn("t", F.when(F.col("cut"), first).otherwise(F.col("t")))
    made = {text: F.col("t")} | ({chars: F.when(F.col("cut"), F.length("t")).otherwise(F.col(f"d.`{chars}`"))} if chars in columns else {})
    return j.select(*[(made[c].cast(docs.schema[c].dataType) if c in made else F.col(f"d.`{c}`")).alias(c) for c in columns])


#: The same mix in closed form: a document's words stand at [at, at + size) of its source, which is read quota words far.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, n::BIGINT AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM (SELECT source, sum(size) AS n FROM d GROUP BY source)
), r AS (SELECT *, (3 * n)::DOUBLE / w AS r FROM s
), l AS (
  SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lam
  FROM r WINDOW b AS (ORDER BY r, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN r > f THEN f * w ELSE (3 * n)::DOUBLE END AS target FROM (SELECT *, (SELECT arg_min(lam, r) FROM l WHERE r > lam) AS f FROM l)
), k AS (SELECT *, CASE WHEN n > 0 THEN (q // n) * blocks + ceil((q % n) / 512.0)::BIGINT ELSE 0 END AS slots FROM (SELECT *, floor(target + 0.5)::BIGINT AS q, ceil(n / 512.0)::BIGINT AS blocks FROM t)
), c AS (SELECT no, slots, (sum(slots) OVER (ORDER BY no))::BIGINT AS hi, (sum(slots) OVER ())::BIGINT AS total FROM k
), u AS (SELECT slot, x - floor(x) AS u FROM (SELECT slot, (slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE AS x FROM range((SELECT coalesce(max(total), 0) FROM c)) g(slot))
), w AS (SELECT no, slots, total, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS r FROM u JOIN c ON u >= (hi - slots)::DOUBLE / total::DOUBLE AND u < hi::DOUBLE / total::DOUBLE
), z AS (
  SELECT no, slot, r FROM w WHERE r < slots
  UNION ALL SELECT no, total, g.r FROM (SELECT no, slots, total, (SELECT count(*) FROM w WHERE w.no = c.no) AS had FROM c) m, LATERAL (SELECT unnest(range(had, slots)) AS r) g
), p AS (
  SELECT d.*, t.n, t.target, t.no, t.blocks, t.q, (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS a
  FROM d JOIN k t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, n AS source_size, target,
  (greatest(0, least(a + size, q) - a) + greatest(0, least(a + size, q - n) - a) + greatest(0, least(a + size, q - 2 * n) - a))::BIGINT AS taken,
  coalesce((SELECT string_agg(z.slot, ',' ORDER BY z.slot, z.r) FROM z WHERE z.no = p.no AND z.r % p.blocks = a // 512 AND size > 0 AND z.r // p.blocks * n + a < q), '') AS slots FROM p
"""
