"""Benchmark decontamination by winnowing: shared fingerprints of k-grams find shared spans, which are then extended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight.llm.common import lower_ascii, materialise, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; of a k-gram. Every window has SPAN - K + 1 k-grams, and the least of their hashes is its fingerprint.
SPAN, K = 13, 8
PER_WINDOW = SPAN - K + 1
#: The low bits of a k-gram's value hold its position, so that equal k-grams differ and a fingerprint lasts PER_WINDOW windows at most.
PLACE_BITS = 24
#: Benchmarks with up to so many fingerprints (some 100 MB) are sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Word hashes as w; the projection is kept apart (through a generator) so that it isn't computed again for each use."""
    return df.withColumn("w", F.explode(F.array(F.transform(words(F.col(text)), lambda x: F.xxhash64(x))))).drop(text)


def fingerprints(hashed: DataFrame) -> DataFrame:
    """A row (nth, fp, ctx) for each fingerprint: ctx has the word hashes of all windows that it stands for, and some of the next.

    Texts of fewer than SPAN words have one row, with a null fingerprint.
    """
    last_k, last_w, none = F.size("w") - K + 1, F.size("w") - SPAN + 1, F.array().cast("array<bigint>")
    low = (1 << PLACE_BITS) - 1
    gram = lambda i: F.xxhash64(F.slice("w", i, K)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint").bitwiseAND(F.lit(low)))
    least = lambda j: F.array_min(F.slice("g", j, PER_WINDOW))
    d = hashed.withColumn("g", F.explode(F.array(F.when(last_w >= 1, F.transform(F.sequence(F.lit(1), last_k), gram)).otherwise(none))))
    d = d.withColumn("m", F.explode(F.array(F.when(last_w >= 1, F.transform(F.sequence(F.lit(1), last_w), least)).otherwise(none)))).drop("g")
    new = F.filter(F.sequence(F.lit(1), F.size("m")), lambda j: (j == 1) | (F.get("m", j - 1) != F.get("m", j - 2)))
    d = d.select("*", F.posexplode_outer(F.when(F.size("m") > 0, new)).alias("nth", "at"))
    fp = F.when(F.col("at").isNotNull(), F.shiftright(F.get("m", F.col("at") - 1), PLACE_BITS))
    return d.withColumn("fp", fp).withColumn("ctx", F.when(F.col("at").isNotNull(), F.slice("w", F.col("at"), SPAN + PER_WINDOW - 1))).drop("m", "w")


def _windows(ctx: Column, at: Column) -> Column:
    """An array of (start, window, check) for each window of SPAN words within ctx, whose first word is word number at: two hashes, 128 bits in all."""
    def window(j: Column) -> Column:
        w = F.slice(ctx, j + 1, SPAN)
        return F.struct((at + j).alias("start"), F.xxhash64(w).alias("window"), F.xxhash64(F.lit(1), w).alias("check"))

    return F.transform(F.sequence(F.lit(0), F.size(ctx) - SPAN), window)


def _listed(windows: DataFrame, of: list[str]) -> DataFrame:
    """Of windows of items (item_id, and the columns of): each window once, with the sorted texts of the ids that have it (null ids aside) and a hash of that list."""
    lists = windows.groupBy(*of).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return lists.withColumn("list", F.unhex(F.md5(F.array_join(F.transform("item_ids", lambda i: F.concat(F.length(i).cast("string"), F.lit(":"), i)), ","))))


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(key, text_hash, n_words, list, start, length): each occurrence in a document of a window of any item, from word start (1 and up), once however many items have it; and (list, item_ids), these as sorted texts.

    Documents without any have a row with a null start. Windows are SPAN consecutive words of an item, or a shorter
    item's words as a whole. A window that a document shares with an item has the same fingerprint in both, so the join on
    fingerprints misses none; the windows around each fingerprint that matches are then compared by 128 bits of
    hashes of their words (shorter items by 64). text_hash tells apart rows that share a key. Documents are read and split once, and once more if there are
    shorter items.
    """
    d = _hashed(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t")), "t").withColumn("n_words", F.size("w"))
    b = materialise(_hashed(benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("t")), "t"), "benchmark-words")
    long_items = b.where(F.size("w") >= SPAN)
    items = _listed(long_items.select("item_id", F.explode(_windows(F.col("w"), F.lit(1))).alias("x")).select("item_id", "x.window", "x.check"), ["window", "check"])
    prints = fingerprints(long_items).select("fp", F.lit(True).alias("near")).distinct()
    sizes = b.select(F.sum(F.size("w")).alias("n"), F.array_sort(F.collect_set(F.when(F.size("w").between(1, SPAN - 1), F.size("w")))).alias("short")).first()
    sent = F.broadcast if (sizes["n"] or 0) <= BROADCAST_ROWS else (lambda x: x)
    found = fingerprints(d).join(sent(prints), "fp", "left").where("near or coalesce(nth, 0) = 0")
    lists = items.select("list", "item_ids")
    items = items.drop("item_ids")
    names = ["key", "text_hash", "n_words", "list", "start", "length"]
    found = found.select("key", "text_hash", "n_words", F.explode_outer(F.when(F.col("near"), _windows(F.col("ctx"), F.col("at")))).alias("x")).select("key", "text_hash", "n_words", "x.start", "x.window", "x.check")
    out = found.join(sent(items.withColumn("same", F.lit(True))), ["window", "check"], "left").withColumn("start", F.when(F.col("same"), F.col("start"))).withColumn("length", F.when(F.col("same"), F.lit(SPAN))).select(*names)
    if sizes["short"]:  # at most SPAN - 1 lengths
        whole = _listed(b.where(F.size("w").between(1, SPAN - 1)).select("item_id", F.xxhash64("w").alias("window"), F.size("w").alias("length")), ["window", "length"])
        runs = F.flatten(F.transform(F.array(*map(F.lit, sizes["short"])), lambda m: F.when(F.size("w") >= m, F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.struct(i.alias("start"), m.alias("length"), F.xxhash64(F.slice("w", i, m)).alias("window")))).otherwise(F.array())))
        grams = d.select("key", "text_hash", "n_words", F.explode(runs).alias("x")).select("key", "text_hash", "n_words", "x.*")
        out = out.unionByName(grams.join(sent(whole.drop("item_ids")), ["window", "length"]).select(*names))
        lists = lists.unionByName(whole.select("list", "item_ids"))
    return out, sent(lists.dropDuplicates(["list"]))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", share: int = 20) -> DataFrame:
    """docs, and columns n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit: words inside any occurrence of a window of an item. contaminated: n_hit > 0 and share * n_hit >= n_words.
    items_sha256: of the item_ids (sorted as strings, joined by commas) whose windows occur. Null and empty texts have no
    words and no hits; repeated rows get equal results; items without words hit nothing; items that share an id count as
    one, those with null ids not at all, but their words are hit. Existing columns of the new names are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    # of a document at most a few spans for each of its words, each different list of items once, and then their members; grouped alike, so dealt out once
    found, lists = hits(docs, benchmark, key, text, item)
    held = F.col("start").isNotNull()
    per_doc = found.groupBy("key", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(held, F.struct("start", "length")))).alias("spans"), F.collect_set(F.when(held, F.col("list"))).alias("lists"),
    )
    per_doc = per_doc.select("key", "text_hash", "n_words", "spans", F.explode_outer("lists").alias("list")).join(lists, "list", "left").groupBy("key", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("ids"),
    )
    added = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct(
        (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["start"] + s["length"]).alias("end")))
    per_doc = per_doc.select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), F.col("n_words").cast("bigint").alias("n_words"), added["n"].cast("bigint").alias("n_hit"), F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    name = unused("text_hash", docs)
    marked, per_doc = docs.withColumn(name, F.xxhash64(text)).alias("d"), per_doc.alias("p")
    out = marked.join(per_doc, (F.col(f"d.{name}") == F.col("p.__hash")) & F.col(f"d.`{key}`").eqNullSafe(F.col("p.__key")), "left")
    n_hit, n_words = F.col("p.n_hit"), F.col("p.n_words")
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns], n_words, n_hit, "p.n_items", "p.items_sha256", ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns that they had, whatever their names; null and empty texts stay."""
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    own = {c: unused(f"own_{c}", docs) for c in docs.columns if c in made}
    judged = contamination(docs.withColumnsRenamed(own), benchmark).where("not contaminated")
    return judged.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Every window of every document against every window of every item.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), h AS (SELECT rid, i, dw.m, item_id FROM dw JOIN bw USING (m, win)
), n AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS k FROM h) GROUP BY rid
), g AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN g USING (rid)
"""
