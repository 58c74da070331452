"""Vector codes: the tree against all entries, and whole results against SQL and a plain loop."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlight.llm import codebooks, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size,spread", [(1, 5), (2, 1), (16, 2), (16, 3000), (200, 4), (256, 100000)])
def test_tree_finds_the_lowest_of_the_nearest(size, spread):
    r = np.random.default_rng(size + spread)
    for d in (1, 3, 8):
        book, x = r.integers(-spread, spread + 1, (size, d)), r.integers(-2 * spread, 2 * spread + 1, (500, d))
        all_of = ((x[:, None] - book[None]) ** 2).sum(2)
        which, best = codebooks.nearest(book, codebooks.tree(book), x)
        assert (which == all_of.argmin(1)).all() and (best == all_of.min(1)).all()  # argmin takes the first of equal ones


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract word by word, in Python's whole numbers."""
    kept = sorted((i, [int(np.floor(np.float64(c) * 4096)) for c in v], lab) for i, v, lab in rows)
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : p * d + d] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(c, p):
        return min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            of = [assign(c, p)[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, of) if o == k]
                if mine:
                    new[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
        books = new
    out = {}
    for (i, _, lab), c in zip(kept, cut):
        found = [assign(c, p) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab)
    return out, np.array(books)


def test_against_a_plain_loop_with_ties(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) / 4096 for v in r.integers(-2, 3, 16)], i % 3 if i % 4 else None) for i in range(120)]
    want, books = plain(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("mine")).withColumn("id", F.lit(1)).repartition(5)
    got = codebooks.compress(df).collect()
    assert {x.vec_id: (x.code, x.error) for x in got} == {i: w[:2] for i, w in want.items()}
    by = {}
    for _, e, lab in want.values():
        by[lab] = by.get(lab, 0) + e
    assert all(x.label_error == by[want[x.vec_id][2]] and x.codebooks_sha256 == codebooks.digest_of(books) for x in got)


def test_odd_rows_against_sql(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(4)
    good = [(i, [float(np.float32(v)) for v in r.normal(0, 0.2, 8)], i % 2) for i in range(10, 30)]
    rows = good + [(1, None, 0), (2, [], 0), (3, [1.0] * 7 + [None], 0), (4, [nan] * 8, 0), (5, [inf] + [0.0] * 7, 1), (6, [0.0] * 9, 1), (7, [40000.0] * 8, 1), (8, [0.0] * 8, None), (8, [0.0] * 8, None), (8, [-0.0001] * 8, 1), (None, [-9.5] * 8, None), (40, [0.5] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(map(tuple, codebooks.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    embeddings = df.toArrow()  # noqa: F841
    want = sorted(duckdb.sql(codebooks.ORACLE_SQL).fetchall(), key=str)
    assert got == want and len(got) == len(good) + 4


def test_few_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codebooks.compress(spark.createDataFrame([], kind)).collect() == []
    assert codebooks.compress(spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    one = codebooks.compress(spark.createDataFrame([(1, [0.25] * 8, 1), (2, [0.25] * 8, 1)], kind)).collect()
    assert [(x.code, x.error) for x in one] == [("00" * 8, 0)] * 2


def test_codes_are_read_back(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    kept = codebooks._whole(rows, "vec_id", "embedding", "label", 8)
    books = codebooks.train(kept)
    coded = codebooks.encode(kept, books).withColumnRenamed("id", "vec_id")
    back = {r.vec_id: np.array(r.vector) for r in codebooks.decode(spark, coded, books).collect()}
    for r in kept.join(coded, kept.id == coded.vec_id).select("vec_id", "vec", "error").collect():
        assert int(((back[r.vec_id] * 4096 - np.array(r.vec)) ** 2).sum()) == r.error


def test_query_against_sql(spark):
    got = queries.op12_vector_codes(spark, SF)
    d = duckdb.connect()
    d.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = d.sql(queries.ORACLE_SQL["op12_vector_codes"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
