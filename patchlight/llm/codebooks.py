"""Vectors as short codes: a codebook for each part of the vectors, trained in rounds, whose nearest entries a kd-tree finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.llm.common import materialise, scratch

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components become whole numbers of this part of one.
SCALE = 4096
#: Components of this size or more have no code: squares and their sums over a vector of up to 64 of them stay below 2**63.
LARGEST = 32768.0
#: Entries of a tree's leaf, at most.
LEAF = 2


class Node(NamedTuple):
    low: np.ndarray  #: the least box that holds the node's entries
    high: np.ndarray
    entries: np.ndarray  #: numbers of a leaf's entries, ascending; of an inner node: none
    below: tuple[Node, Node] | None


def tree(book: np.ndarray, at: np.ndarray | None = None) -> Node:
    """A kd-tree over a codebook (entries by components): cut at the median of the widest component until LEAF entries are left."""
    at = np.arange(len(book)) if at is None else at
    low, high = book[at].min(0), book[at].max(0)
    if len(at) <= LEAF or (low == high).all():
        return Node(low, high, np.sort(at), None)
    by = at[np.argsort(book[at, int(np.argmax(high - low))], kind="stable")]
    half = len(by) // 2
    return Node(low, high, at[:0], (tree(book, by[:half]), tree(book, by[half:])))


def nearest(book: np.ndarray, root: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (whole numbers) the nearest entry, of equally near ones the lowest, and its squared distance.

    Branch and bound over all rows at once: rows visit the nearer branch first, and a node only if its box is no farther
    than the nearest entry so far. A box that is just as far is visited, as it may hold an entry of a lower number.
    """
    best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book))

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        out = np.maximum(np.maximum(node.low - x[rows], x[rows] - node.high), 0)
        return (out * out).sum(1)

    def visit(node: Node, rows: np.ndarray, bounds: np.ndarray) -> None:
        rows = rows[bounds <= best[rows]]
        if not len(rows):
            return
        if node.below is None:
            for e in node.entries:
                d = x[rows] - book[e]
                d = (d * d).sum(1)
                better = (d < best[rows]) | (d == best[rows]) & (e < which[rows])
                best[rows[better]], which[rows[better]] = d[better], e
            return
        left, right = node.below
        to_left, to_right = bound(left, rows), bound(right, rows)
        first = to_left <= to_right
        visit(left, rows[first], to_left[first])
        visit(right, rows, to_right)
        visit(left, rows[~first], to_left[~first])

    every = np.arange(len(x))
    visit(root, every, bound(root, every))
    return which, best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), parts, -1)


def _whole(rows: DataFrame, key: str, vector: str, label: str, parts: int) -> DataFrame:
    e = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0)
    whole = F.transform(e, lambda v: F.floor(v * F.lit(float(SCALE))).cast("int"))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("id"), F.col(label).alias("label"), whole.alias("vec"))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts by entries by components) of whole vectors of one size (id, vec), which are read once a round.

    Each starts as the parts of the vectors of the least ids (null last; of one id by vector). A round sends a tree for
    each codebook to all tasks, whose sums by entry are added up as whole numbers: a task gives parts * entries *
    (components + 1) numbers, however many rows it has. Entries that are nobody's nearest stay as they are.
    """
    spark = kept.sparkSession
    first = kept.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    books = np.array([r["vec"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    k, d = books.shape[1:]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast([(b, tree(b)) for b in books])

        def summed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, k, d + 1), np.int64)
            for b in batches:
                if not len(b):
                    continue
                x = _matrix(b.column("vec"), parts)
                for p, (book, root) in enumerate(sent.value):
                    which, _ = nearest(book, root, x[:, p])
                    sums[p, :, d] += np.bincount(which, minlength=k)
                    for j in range(d):  # a batch's sums are below 2**53
                        sums[p, :, j] += np.bincount(which, x[:, p, j], k).astype(np.int64)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums.ravel()[some])], ["cell", "total"])

        found = kept.select("vec").mapInArrow(summed, "cell int, total bigint").groupBy("cell").agg(F.sum("total").alias("total")).collect()
        sums = np.zeros(parts * k * (d + 1), np.int64)
        for r in found:
            sums[r["cell"]] = r["total"]
        sums = sums.reshape(parts, k, d + 1)
        used = sums[:, :, d] > 0
        books = books.copy()
        books[used] = sums[used][:, :d] // sums[used][:, d:]
        sent.destroy()
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of whole vectors: the nearest entries' numbers in order of parts, two hex digits each, and the sum of squared distances."""
    parts = len(books)
    sent = kept.sparkSession.sparkContext.broadcast([(b, tree(b)) for b in books])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("vec"), parts)
            found = [nearest(book, root, x[:, p]) for p, (book, root) in enumerate(sent.value)]
            codes = np.stack([w for w, _ in found], 1).astype(np.uint8)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(sum(e for _, e in found))], ["id", "label", "code", "error"])

    return kept.mapInArrow(coded, T.StructType([kept.schema["id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def digest_of(books: np.ndarray) -> str:
    """The SHA-256 of all entries' components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each row that has a code, by codebooks trained on all of them.

    Rows whose vector is null or empty, holds a null, an infinity, NaN or a component of LARGEST or more, or can't be cut into
    parts of one size, have no code; nor have vectors of another size than that of the least key. With fewer rows than
    entries, codebooks have fewer. Repeated rows are rows of their own; a null key seeds last; null labels are equal
    (label_error: error summed over the label); an empty table gives no rows; other columns don't matter.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    spark = rows.sparkSession
    with scratch(spark):
        kept = materialise(_whole(rows, key, vector, label, parts), "codes-whole")
        least = kept.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").first()
        if least is not None:
            kept = kept.where(F.size("vec") == len(least["vec"]))
        books = train(kept, parts, entries, rounds) if least is not None else np.zeros((parts, 0, 0), np.int64)
        coded = encode(kept, books) if least is not None else kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        coded = materialise(coded, "codes", keep=True)
    # a row for each label; Spark sends it to all tasks only if it has found it small
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def decode(spark: SparkSession, coded: DataFrame, books: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, vector): the entries that codes name, as real numbers again."""
    parts = len(books)
    flat = [[float(v) / SCALE for v in e] for b in books for e in b]
    held = F.array(*(F.array(*map(F.lit, e)) for e in flat))
    number = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * books.shape[1]
    return coded.select(key, F.flatten(F.array(*(F.element_at(held, number(p) + 1) for p in range(parts)))).alias("vector"))


def _oracle() -> str:
    """All parts against all entries, round after round."""
    near = "SELECT rid, part, min({{'d': list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i])))::BIGINT, 'e': entry}}) AS m FROM p JOIN c{0} USING (part) GROUP BY rid, part"
    sql = f"""WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST})) = 0
), k AS MATERIALIZED (SELECT * FROM w WHERE len(v) = (SELECT len(v) FROM w ORDER BY vec_id NULLS LAST, v LIMIT 1)), p AS MATERIALIZED (
  SELECT rid, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v FROM k, range({PARTS}) r(part)
), s AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM k QUALIFY entry < {ENTRIES}), c0 AS MATERIALIZED (SELECT part, entry, v AS e FROM p JOIN s USING (rid))"""
    for r in range(ROUNDS):
        sql += f""", a{r} AS MATERIALIZED ({near.format(r)}), n{r} AS (
  SELECT part, entry, list(x ORDER BY i) AS e FROM (SELECT part, m.e AS entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM p JOIN a{r} USING (rid, part), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN n{r} USING (part, entry))"""
    return sql + f""", z AS ({near.format(ROUNDS)}), g AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM z GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256 FROM g JOIN k USING (rid)"""


ORACLE_SQL = _oracle()
