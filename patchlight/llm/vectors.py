"""Near-duplicate vectors: Euclidean p-stable hashing of normalised vectors in several tables, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.llm.common import components, least_reached, materialise, scratch
from patchlight.llm.tokens import mix

SIMILAR = 0.98
#: Length of a projection's stretches. Vectors of cosine 0.98 (0.2 apart) share one with probability 0.9, unrelated ones with 0.42, about.
WIDTH, UNRELATED = 1.6, 0.42
#: So many unrelated vectors of its label, at most, share a table's bucket with a vector, on the mean: sets the number of projections.
STRANGERS = 0.02
#: What part of the pairs of cosine 0.98 no table finds, at most (nearer ones: fewer): sets the number of tables.
MISSED = 2e-4
#: Buckets are compared in blocks of two chunks of about so many vectors.
CHUNK = 512
#: Runs of so many vectors at most are compared together, pair by pair.
SHORT = 24
SALTS = 64


def near_share() -> float:
    """The probability that two vectors of cosine SIMILAR share a projection's stretch."""
    c = math.sqrt(2 - 2 * SIMILAR)
    tail = 0.5 * math.erfc(WIDTH / c / math.sqrt(2))
    return 1 - 2 * tail - 2 * c / (math.sqrt(2 * math.pi) * WIDTH) * (1 - math.exp(-(WIDTH**2) / (2 * c * c)))


def shape_for(n: int) -> tuple[int, int]:
    """Tables and projections for labels of n vectors at most: projections grow with the logarithm of n, and tables so that as few pairs are missed: as n to the power of 0.12."""
    projections = max(4, math.ceil(math.log(max(n, 1) / STRANGERS) / -math.log(UNRELATED)))
    return math.ceil(math.log(MISSED) / math.log(1 - near_share() ** projections)), projections


@lru_cache(maxsize=8)
def _projections(size: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng([size, tables, projections])
    return r.standard_normal((size, tables * projections)), r.uniform(0, WIDTH, tables * projections), mix(np.arange(1, projections + 1, dtype=np.uint64)) | np.uint64(1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one size, in double precision, at length 1; brought to a like size by powers of two first, so that no square is too large or small."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keys(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The buckets (rows by tables) of vectors of length 1."""
    p, at, mult = _projections(x.shape[1], *shape)
    cell = np.floor((x @ p + at) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), *shape)
    return mix((cell * mult).sum(2)).astype(np.int64)


def block_links(x: np.ndarray, k: np.ndarray, copies: np.ndarray, table: int, chunk: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray] | None:
    """Of the vectors of a block: links (as copies of the partner) that no earlier table has, and the least place in the block that links reach."""
    linked = x @ x.T >= SIMILAR
    np.fill_diagonal(linked, False)
    if pair[0] != pair[1]:
        linked &= chunk[:, None] != chunk[None, :]
    a, b = np.nonzero(linked)
    if not len(a):
        return None
    reached = least_reached(a, b, len(x))
    for t in range(table):  # near vectors share many tables: few links are left soon
        new = k[a, t] != k[b, t]
        a, b = a[new], b[new]
    return np.bincount(a, copies[b], len(x)).astype(np.int64), reached


def pair_links(x: np.ndarray, k: np.ndarray, table: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linked pairs (a, b) of rows that stand in one run, and whether no table before the run's has them; runs are sorted and short."""
    found = []
    for d in range(1, int(np.bincount(run - run.min()).max())):
        a = np.flatnonzero(run[d:] == run[:-d])
        for at in range(0, len(a), 1 << 15):
            part = a[at : at + (1 << 15)]
            found.append(part[np.einsum("ij,ij->i", x[part], x[part + d]) >= SIMILAR].astype(np.int64) + (d << 32))
    pairs = np.concatenate(found) if found else np.empty(0, np.int64)
    a = pairs & 0xFFFFFFFF
    b = a + (pairs >> 32)
    new = np.ones(len(a), bool)
    for t in range(int(table.max(initial=0))):
        new &= (table[a] <= t) | (k[a, t] != k[b, t])
    return a, b, new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of (cell, i, j): of short runs all at once, of longer ones each by a product of matrices."""
    names = ["node", "root", "degree"]

    def arrays(t: pa.Table) -> tuple[np.ndarray, ...]:
        return tuple(t.column(n).to_numpy() for n in ("node", "copies", "table", "group"))

    def short(t: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = t.column("size").to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            part = t.take(pa.array(at))
            node, copies, table, group = arrays(part)
            k = part.column("keys").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
            a, b, new = pair_links(_matrix(part.column("vec").combine_chunks()), k, table, run[at])
            same = group[a] == group[b]  # other groups share a cell only if hashes collide
            a, b, new = a[same], b[same], new[same]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[np.r_[a, b]]), pa.array(node[np.r_[b, a]]), pa.array(np.r_[copies[b] * new, copies[a] * new])], names)

    def long(run: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = np.stack([run.column(n).to_numpy() for n in ("size", "group", "table")], 1)
        for kind in np.unique(kinds, axis=0):
            t = run.filter(pa.array((kinds == kind).all(1)))
            x, k = _matrix(t.column("vec").combine_chunks()), t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            found = block_links(x, k, t.column("copies").to_numpy(), int(kind[2]), t.column("chunk").to_numpy(), (t.column("i")[0].as_py(), t.column("j")[0].as_py()))
            if found is not None:
                degree, root = found
                some, node = np.flatnonzero((degree > 0) | (root != np.arange(len(t)))), t.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(degree[some])], names)

    def whole(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(np.r_[starts, len(t)])
        run = np.repeat(np.arange(len(starts)), lengths)
        few = (lengths <= SHORT) & (t.column("i").to_numpy()[starts] == t.column("j").to_numpy()[starts])
        at = np.flatnonzero(few[run])
        if len(at):
            yield from short(t.take(pa.array(at)), run[at])
        for r in np.flatnonzero(~few):
            yield from long(t.slice(starts[r], lengths[r]))

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not len(t):
            continue
        c = np.stack([t.column(n).to_numpy() for n in ("cell", "i", "j")], 1)
        starts = np.r_[0, np.flatnonzero((c[1:] != c[:-1]).any(1)) + 1]
        yield from whole(t.slice(0, starts[-1]), starts[:-1]) if len(starts) > 1 else ()
        held = t.slice(starts[-1])
    if held is not None and len(held):
        yield from whole(held, np.array([0]))


def links(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row (key, n_links, component_id, kept) for each row: vectors link if their labels are equal and their cosine is SIMILAR at least.

    n_links counts the other rows linked directly, component_id is the least key that links reach (the row's own, at
    least), kept says whether it is the row's own. Vectors link with nothing, whatever their labels, if they are null,
    empty or zero, or hold nulls, infinities or NaN; so do those with null labels, and vectors of different sizes with
    each other. Repeated rows are vectors of their own. A null key is nobody's least key; other columns don't matter.

    Equal vectors of a label are joined first and counted as copies. A pair that several tables find counts in the first.
    The largest label's number of rows sets how many tables and projections there are (see shape_for), so unrelated vectors
    share few buckets however many there are. Buckets of n vectors are compared in (n / CHUNK)**2 / 2 blocks, none larger
    than two chunks; of a block only sums go on.
    """
    e = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.col(label).isNotNull() & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    largest = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    shape = shape_for(largest)
    # vectors go as they came, in single precision if they came so
    kept = F.col(vector) if dict(rows.dtypes)[vector] in ("array<float>", "array<double>") else e
    rows = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.when(fine, kept).alias("vec"))
    same = F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.col("vec").cast("array<string>"), ","))))
    rows = rows.withColumn("same", F.when(F.col("vec").isNotNull(), same))
    reps = rows.where("same is not null").groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    reps = reps.select("same", "id", "copies", F.xxhash64(F.col("label").cast("string")).alias("group"), F.size("vec").alias("size"), "vec")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sizes = b.column("size").to_numpy()
            for n in np.unique(sizes):
                part = b.take(pa.array(np.flatnonzero(sizes == n)))
                k = keys(_matrix(part.column("vec")), shape)
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, shape[0], dtype=np.int32)), pa.array(k.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "keys"])

    made = T.StructType([*reps.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    with scratch(rows.sparkSession):
        # nodes get their numbers as they are written, once
        reps = materialise(reps.mapInArrow(hashed, made).withColumn("node", F.monotonically_increasing_id()), "vectors-hashed")
        cells = reps.select("node", "group", "size", F.posexplode("keys").alias("table", "key")).select("node", "table", F.xxhash64("group", "size", "table", "key").alias("cell"))
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        placed = cells.join(sizes, "cell").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node", "table"), F.col("chunks")))
        placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        placed = placed.select("node", "table", "cell", "chunk", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
        blocks = placed.join(reps.select("node", "group", "size", "copies", "vec", "keys"), "node")
        order = ["cell", "i", "j"]
        blocks = blocks.repartition(*order).sortWithinPartitions(*order)
        found = materialise(blocks.mapInArrow(_compare, "node bigint, root bigint, degree bigint"), "vectors-found")
        degrees = found.groupBy("node").agg(F.sum("degree").alias("degree"))
        of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors-links")
        known = reps.select("node", "same", "id", "copies").join(degrees, "node", "left").join(of, "node", "left")
        known = known.select("node", "same", "id", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
        # the members of a large class are split over SALTS places, to each of which the least key goes
        known = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        least = known.groupBy("root", "salt").agg(F.min("id").alias("id")).groupBy("root").agg(F.min("id").alias("component_id"), F.collect_list("salt").alias("salts"))
        known = known.join(least.select("root", "component_id", F.explode("salts").alias("salt")), ["root", "salt"]).select("same", "n_links", "component_id")
        known = materialise(known, "vectors-known", keep=True)
    out = rows.select("id", "same").join(known, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: All pairs of a label, and components by widening each vector's reach until nothing is added.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) END / (a.n * b.n) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM ok UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS c FROM r GROUP BY a), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id
"""
