"""Near-duplicate texts: improved consistent weighted sampling of TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.llm.common import components, least_reached, materialise, scratch, sorted_runs, unused
from patchlight.llm.tokens import mix, shingles

#: Words of a shingle; least similarity of a link.
WORDS, SIMILAR = 5, 0.8
#: Bands of samples: texts of similarity 0.8 share a band with probability 0.998, of 0.9 with all but certainty.
BANDS, ROWS = 12, 4
#: Document frequencies are kept in a count-min sketch of so many counters in each of two rows, whatever the corpus: 8 MB.
#: It counts all documents; frequencies are over-estimated by at most what falls into a shingle's two counters.
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: Shingles that at most this part of the texts has are equally rare. It lies above the sketch's error, which is a part of the
#: texts as well: a text's shingles by COUNTERS, 0.0003 for 300 of them, however many texts there are.
RARE = 2.0**-10
#: Texts, about, and characters of a chunk: what is compared at once.
CHUNK, CHARS = 256, 1 << 24
#: What rounding may do to a distance.
SLACK = 1e-9
SALTS = 64
_CHUNK, _SLAB = 512, 4096


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(44)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """The sketch (2 by COUNTERS) of how many texts have a shingle, and the number of texts.

    Tasks send their counters in blocks, which are added up in a stream: neither the driver nor a task ever holds more
    than the sketch.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, n = np.zeros((2, COUNTERS), np.int64), 0
        for f in frames:
            n += len(f)
            first, second, held = [], [], 0
            for t in f["t"]:
                a, b = _cells(shingles(t, WORDS)[0])
                first.append(a)
                second.append(b)
                held += len(a)
                if held > COUNTERS:
                    sketch[0] += np.bincount(np.concatenate(first), minlength=COUNTERS)
                    sketch[1] += np.bincount(np.concatenate(second), minlength=COUNTERS)
                    first, second, held = [], [], 0
            if first:
                sketch[0] += np.bincount(np.concatenate(first), minlength=COUNTERS)
                sketch[1] += np.bincount(np.concatenate(second), minlength=COUNTERS)
        for k, block in enumerate(sketch.reshape(-1, BLOCK)):
            if block.any():
                small = block.max() < 1 << 16
                yield pd.DataFrame({"block": [k], "n": [block.astype(np.uint16 if small else np.int64).tobytes()]})
        yield pd.DataFrame({"block": [-1], "n": [np.array([n], np.int64).tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for k, b in zip(f["block"], f["n"]):
                wide = 1 if k < 0 else BLOCK
                x = np.frombuffer(b, np.int64 if len(b) == 8 * wide else np.uint16).astype(np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield pd.DataFrame({"block": list(sums), "n": [x.tobytes() for x in sums.values()]})

    shape = "block int, n binary"
    sums = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(count, shape).repartition(16, "block").mapInPandas(add, shape)
    sketch, n = np.zeros((2 * COUNTERS // BLOCK, BLOCK), np.int64), 0
    for r in sums.collect():  # 2 * COUNTERS / BLOCK rows
        x = np.frombuffer(r["n"], np.int64)
        if r["block"] < 0:
            n = int(x[0])
        else:
            sketch[r["block"]] = x
    return sketch.reshape(2, COUNTERS), n


def idf_of(sketch: np.ndarray, n: int) -> np.ndarray:
    """1 plus half the logarithm of the part of the n texts that has a shingle, by that of RARE: from 1 (all) to 1.5 (RARE or less).

    It follows from parts alone, so a corpus of a thousand times the texts weighs a shingle alike. Counters count less what
    one holds on average, which is what other shingles add. So damped, what many copies share counts for nearly as much
    as what sets one of them apart.
    """
    part = (sketch - sketch.mean(1, keepdims=True)) / max(n, 1)
    return (1 + np.log(np.clip(part, RARE, 1)) / np.log(RARE) / 2).astype(np.float32)


def weigh(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and their weights: count times inverse document frequency."""
    h, n = shingles(text, WORDS)
    a, b = _cells(h)
    return h, n * np.maximum(idf[0, a], idf[1, b]).astype(np.float64)


def similarities(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of weighed texts: the sum of minima by the sum of maxima."""
    n = len(texts)
    who = np.repeat(np.arange(n), [len(h) for h, _ in texts])
    h, w = np.concatenate([h for h, _ in texts]), np.concatenate([w for _, w in texts])
    order = np.argsort(h, kind="stable")
    h, w, who = h[order], w[order], who[order]
    column = np.cumsum(np.r_[False, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    size = np.bincount(column) if len(h) else np.empty(0, np.int64)
    low = np.zeros((n, n))
    firsts = np.r_[0, np.cumsum(size)[:-1]] if len(h) else np.empty(0, np.int64)
    if len(h):
        even = np.minimum.reduceat(w, firsts) == np.maximum.reduceat(w, firsts)
        # shingles that weigh the same in all texts that have them: a product of matrices
        number = np.cumsum((size > 1) & even) - 1
        mine = ((size > 1) & even)[column]
        at, of, weight = number[column[mine]], who[mine], w[mine]
        for k in range(0, int(number[-1]) + 1, _SLAB):
            a, b = np.searchsorted(at, [k, k + _SLAB])
            x = np.zeros((n, min(_SLAB, int(number[-1]) + 1 - k)))
            x[of[a:b], at[a:b] - k] = np.sqrt(weight[a:b])
            low += x @ x.T
        for c in np.flatnonzero((size > 1) & ~even):
            part = slice(firsts[c], firsts[c] + size[c])
            low[np.ix_(who[part], who[part])] += np.minimum(w[part][:, None], w[part][None, :])
    total = np.array([v.sum() for _, v in texts])
    top = total[:, None] + total[None, :] - low
    return np.divide(low, top, out=np.zeros((n, n)), where=top > 0)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2**16 places and their logarithms; an odd multiplier for each sample."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):  # halving: the distribution function is 1 - (1 + x) exp(-x)
        x = (lo + hi) / 2
        above = 1 - (1 + x) * np.exp(-x) > p
        hi[above], lo[~above] = x[above], x[~above]
    return x.astype(np.float32), np.log(x).astype(np.float32), mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each of BANDS * ROWS draws the consistent weighted sample, a shingle and its level, as a 64-bit number.

    Two texts draw the same one with the probability of their weighted Jaccard similarity.
    """
    gamma, log_gamma, multipliers = _draws()
    best, found = np.full(len(multipliers), np.inf, np.float32), np.zeros(len(multipliers), np.uint64)
    rows = np.arange(len(multipliers))
    for at in range(0, len(h), _CHUNK):
        e, s = h[at : at + _CHUNK], np.log(w[at : at + _CHUNK]).astype(np.float32)
        bits = (e[None, :] * multipliers[:, None]).view(np.uint16).reshape(len(rows), len(e), 4)
        r = gamma.take(bits[..., 2])
        beta = bits[..., 3] * np.float32(2.0**-16)
        t = s / r
        t += beta
        np.floor(t, out=t)
        score = t - beta
        score += np.float32(1)
        score *= r
        np.subtract(log_gamma.take(bits[..., 1]), score, out=score)
        i = score.argmin(1)
        least = score[rows, i]
        better = least < best
        best[better] = least[better]
        found[better] = mix(e[i] ^ (t[rows, i].astype(np.int64).astype(np.uint64) << np.uint64(1)))[better]
    return found


def _bands(rows: DataFrame, idf: Broadcast) -> DataFrame:
    """(id, node, chars, bands) of rows (id, node, t): one 64-bit key for each band, none for texts without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        mult = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            keys = []
            for t in b.column("t"):
                h, w = weigh(t.as_py(), table)
                keys.append(mix((samples(h, w).reshape(BANDS, ROWS) * mult).sum(1)).astype(np.int64) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("node"), pc.utf8_length(b.column("t")).cast(pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "chars", "bands"])

    shape = T.StructType([rows.schema["id"], rows.schema["node"], T.StructField("chars", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return rows.select("id", "node", "t").mapInArrow(sign, shape)


def _compared(blocks: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """(node, root, band, key, far) of blocks (band, key, i, j, node, chunk, pivot).

    With a root: node is linked to it over links within the block. With far: its distance from the block's pivot.
    Links are looked for between the chunks i and j, or all rows if they are the same.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        names = ["node", "root", "band", "key", "far"]
        for t in sorted_runs(batches, ["band", "key", "i", "j"]):
            if len(t) < 2:
                continue
            s = similarities([weigh(x.as_py(), table) for x in t.column("t")])
            linked = s >= SIMILAR - SLACK
            if t.column("i")[0].as_py() != t.column("j")[0].as_py():
                chunk = t.column("chunk").to_numpy()
                linked &= chunk[:, None] != chunk[None, :]
            root = least_reached(*np.nonzero(linked), len(t))
            nodes = t.column("node").combine_chunks()
            band, key = t.column("band").combine_chunks(), t.column("key").combine_chunks()
            some = pa.array(np.flatnonzero(root != np.arange(len(t))))
            if len(some):
                yield pa.RecordBatch.from_arrays([nodes.take(some), nodes.take(pa.array(root[some.to_numpy()])), band.take(some), key.take(some), pa.nulls(len(some), pa.float64())], names)
            pivot = np.flatnonzero(t.column("pivot").to_numpy(zero_copy_only=False))
            if len(pivot):
                yield pa.RecordBatch.from_arrays([nodes, pa.nulls(len(t), pa.binary()), band, key, pa.array(1 - s[:, pivot[0]])], names)

    order = ["band", "key", "i", "j"]
    rows = blocks.join(texts, "node").select(*order, "chunk", "pivot", "node", "t")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(judge, "node binary, root binary, band int, key bigint, far double")


def _chunked(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (band, key, node) of buckets (band, key, n, chars), and columns chunks, chunk: chunks hold CHUNK texts, about, and CHARS characters."""
    out = rows.join(buckets.withColumn("chunks", F.ceil(F.greatest(F.col("n") / CHUNK, F.col("chars") / CHARS))).drop("n", "chars"), ["band", "key"])
    return out.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))


def _linked(nodes: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame | None:
    """(node, root) of the texts that link, directly or not, to others; None if no two of nodes (node, bands, chars) share a band.

    Texts that share a band's key are a bucket; buckets with the same texts count once. Buckets are cut into chunks. First
    each chunk is compared as a whole, and with one pivot for all chunks of its bucket. Settled is then who is in the
    pivot's component and nearer to the pivot than any text of another component by more than 1 - SIMILAR: by the
    triangle inequality (weighted Jaccard distance is a metric) it links with none of those. All others are compared
    across chunks, unless the bucket is one component by now. So of the links between texts that share a band only such
    are left out that components don't need; a bucket of copies, however large, costs one comparison with each chunk,
    and of a mixed one of n texts (n / CHUNK)**2 / 2 blocks are compared, of which only sums go on.
    """
    cells = nodes.select("node", "chars", F.posexplode("bands").alias("band", "key"))
    buckets = cells.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.min(F.struct(F.xxhash64("node", F.lit(2)).alias("h"), "node"))["node"].alias("pivot"),
    ).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key", "chars", "pivot")).alias("b")).select("n", "b.*")
    buckets = materialise(buckets, "neardup-buckets")
    placed = materialise(_chunked(cells.select("band", "key", "node"), buckets.drop("pivot")), "neardup-placed")
    if not placed.take(1):
        return None
    wide = buckets.join(placed.where("chunks > 1").select("band", "key", "chunks").distinct(), ["band", "key"])
    pivots = wide.select("band", "key", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    members = placed.join(wide.select("band", "key", "pivot"), ["band", "key"], "left").where("pivot is null or node <> pivot").select("band", "key", "node", "chunk", F.lit(False).alias("pivot"))
    first = members.unionByName(pivots.select("band", "key", "node", "chunk", F.lit(True).alias("pivot")))
    first = materialise(_compared(first.withColumns({"i": F.col("chunk"), "j": F.col("chunk")}), texts, idf), "neardup-first")
    links = first.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(links, "neardup-links")
    if not wide.take(1):
        return roots
    m = first.where("far is not null").select("band", "key", "node", "far").distinct().join(wide.select("band", "key", "pivot"), ["band", "key"]).where("node <> pivot")
    for c in ("node", "pivot"):
        m = m.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    m = materialise(m.select("band", "key", "node", F.col("node_root").alias("root"), (F.col("node_root") != F.col("pivot_root")).alias("other"), "far"), "neardup-judged")
    least = m.groupBy("band", "key").agg(F.min(F.when(F.col("other"), F.col("far"))).alias("least")).where("least is not null")
    left = m.join(least, ["band", "key"]).where(F.col("other") | (F.col("far") >= F.col("least") - (1 - SIMILAR) - SLACK)).drop("least")
    again = left.join(nodes.select("node", "chars"), "node").groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    again = _chunked(left.select("band", "key", "node"), again.select("band", "key", "n", "chars"))
    again = again.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    again = again.select("band", "key", "node", "chunk", F.lit(False).alias("pivot"), F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    second = materialise(_compared(again, texts, idf), "neardup-second")
    return components(links.unionByName(second.select(F.col("node").alias("a"), F.col("root").alias("b"))), "neardup-links")


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, str, str]:
    """docs with two more columns, whose names follow, of the key and of the MD5 of the text; and (id, node, class_id, first) for each pair of them."""
    spark, k, n = docs.sparkSession, unused("key", docs), unused("node", docs)
    docs = docs.withColumns({k: F.col(f"`{key}`"), n: F.unhex(F.md5(F.col(f"`{text}`")))})
    rows = docs.select(F.col(k).alias("id"), F.col(n).alias("node"), F.col(f"`{text}`").alias("t")).where("t is not null")
    with scratch(spark):
        idf = spark.sparkContext.broadcast(idf_of(*frequencies(docs, text)))
        signed = materialise(_bands(rows, idf), "neardup-bands")
        order = F.struct(F.col("id").isNull().alias("no"), "id")  # null keys last
        nodes = materialise(signed.groupBy("node").agg(F.min(order)["id"].alias("id"), F.first("bands").alias("bands"), F.first("chars").alias("chars")), "neardup-nodes")
        cells = nodes.select("node", F.posexplode("bands").alias("band", "key"))
        shared = cells.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
        near = materialise(cells.join(shared, ["band", "key"], "left_semi").select("node").distinct(), "neardup-near")
        picked = nodes.join(near, "node", "left_semi")
        # by key and text: copies of a text don't meet in one task
        texts = rows.join(picked.select(F.col("node").alias("pn"), F.col("id").alias("pi")), (F.col("node") == F.col("pn")) & F.col("id").eqNullSafe(F.col("pi"))).select("node", "id", "t").dropDuplicates(["node", "id"])
        roots = _linked(picked.select("node", "bands", "chars"), materialise(texts.select("node", "t"), "neardup-texts"), idf)
        label = nodes.select("node", "id")
        label = label.withColumn("root", F.col("node")) if roots is None else label.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
        # the members of a large class are split over SALTS places, to each of which the least key goes
        label = label.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        member = F.struct(F.col("id").isNull().alias("no"), "id", "node")
        least = label.groupBy("root", "salt").agg(F.min(member).alias("least")).groupBy("root").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts"))
        least = least.select("root", "least", F.explode("salts").alias("salt"))
        of = label.join(least, ["root", "salt"]).select("node", F.col("least.id").alias("class_id"), F.col("least.node").alias("kept_node"))
        pairs = signed.select("id", "node").distinct().join(of, "node")
        first = (F.col("node") == F.col("kept_node")) & F.col("id").eqNullSafe(F.col("class_id"))
        return docs, materialise(pairs.select("id", "node", "class_id", first.alias("first")), "neardup-classes", keep=True), k, n


def _one_each(docs: DataFrame, k: str, n: str, name: str) -> DataFrame:
    """docs, and whether a row is the first one of its key and text."""
    return docs.withColumn(name, F.row_number().over(Window.partitionBy(n, k).orderBy(k)) == 1)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, and columns class_id, kept.

    class_id: the least key that can be reached over links; texts link if they are equal, or have words and a weighted
    Jaccard similarity of SIMILAR at least. kept: true for one row of each class, one with that key (of several texts
    with it, the least by MD5; of repeated rows, any one). Null texts link with nothing and are kept, with their own keys
    as class_id; texts without words link with their equals only. Null keys come last: a class of null keys only has a
    null class_id. Existing columns of these names are replaced; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("class_id", "kept")]
    docs, of, k, n = _classes(docs.select(*[F.col(f"`{c}`") for c in names]), key, text)
    one = unused("one", docs)
    docs, of = _one_each(docs, k, n, one).alias("d"), of.alias("o")
    j = docs.join(of, (F.col(f"d.{n}") == F.col("o.node")) & F.col(f"d.{k}").eqNullSafe(F.col("o.id")), "left")
    none = F.col(f"d.{n}").isNull()
    return j.select(*[F.col(f"d.`{c}`") for c in names], F.when(none, F.col(f"d.{k}")).otherwise(F.col("o.class_id")).alias("class_id"), (none | (F.col("o.first") & F.col(f"d.{one}"))).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that classes() keeps."""
    names = docs.columns
    docs, of, k, n = _classes(docs, key, text)
    firsts, one = of.where("first").select(F.col("node").alias(n), F.col("id").alias(k)).alias("o"), unused("one", docs)
    kept = docs.alias("d").join(firsts, (F.col(f"d.{n}") == F.col(f"o.{n}")) & F.col(f"d.{k}").eqNullSafe(F.col(f"o.{k}")), "left_semi")
    kept = _one_each(kept, k, n, one).where(f"`{one}`")
    return kept.unionByName(docs.where(f"`{n}` is null").withColumn(one, F.lit(True))).select(*[F.col(f"`{c}`") for c in names])
