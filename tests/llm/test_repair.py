"""Repair of conversations: every possible edit by brute force, SQL, and pieces of any size."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from patchlight.llm import queries, repair

SF = "/root/testdata/sf0.001"
NOTHING = hashlib.sha256().hexdigest()
ROW = "conv_id long, turn long, role string, text string"


def every_edit(rows):
    """Of rows (role, text, fault): the least (cost, edits) of all edits, and the text that they give."""
    best, most = None, 2 * len(rows)  # deleting all is always possible

    def go(i, cost, edits, lines, inserted=0):
        nonlocal best
        if cost > most:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
            found = cost, edits, "\n".join(f"{r}:{t}" for r, t in lines)
            best = found if best is None else min(best, found)
        for r in ("user", "assistant"):
            go(i, cost + 5, edits + "I", [*lines, (r, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, edits + "D", lines)
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                if role:
                    go(i + 1, cost + late, edits + "K", [*lines, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + late + 1, edits + "R", [*lines, (r, text)])

    go(0, 0, "", [])
    return best


def plain(rows):
    """The contract word by word: rows (conv_id, turn, role, text) to what the query returns."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    result = set()
    for conv, out in convs.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in out:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in out if t is not None]
        n = lambda what: sum(f == what for _, _, f in judged)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, edits, text = every_edit(judged)
        result.add((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()))
    return result


def odd_rows(seed, conversations=60, most=5):
    r = random.Random(seed)
    texts = ["Yes.", "no", "", None, " \n", "Why?!", "a. b", "Yes.", "Ends so. \t", "é…", "!"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "admin", "", "User"]
    rows = []
    for c in [None, *range(conversations)]:
        for t in range(r.randint(1, most)):
            rows.append((c, r.choice([t, t, t, 0, None, 10 * t, -t]), r.choice(roles), r.choice(texts)))
    return rows


def sql(frame, name="conversations"):
    d = duckdb.connect()
    d.register(name, frame.toArrow())
    return set(d.sql(repair.ORACLE_SQL).fetchall())


def test_against_every_edit(spark):
    rows = odd_rows(1)
    df = spark.createDataFrame(rows, ROW).withColumns({n: F.lit("mine") for n in ("piece", "segment", "cost", "audit")}).repartition(3)
    got = [tuple(r) for r in repair.repair_damaged(df).collect()]
    want = plain(rows)
    assert len(got) == len(want) and set(got) == want
    assert sql(df.select("conv_id", "turn", "role", "text")) == want


def test_ways_through_pieces_join_to_the_whole(spark, monkeypatch):
    """Long conversations, cut into many segments, pieces and batches, against the SQL, which takes each as a whole."""
    r = random.Random(5)
    rows = [(c, r.choice([t, t, 700 * t - 3000]), r.choice(["user", "assistant", "system", "user", "assistant", "x"]), r.choice(["Yes.", "no", f"text {t}.", f"cut {t}", "What?"])) for c in (1, 2, 3) for t in range(150 * c)]
    df = spark.createDataFrame(rows, ROW).repartition(4)
    whole = sql(df)
    assert {tuple(x) for x in repair.repair_damaged(df).collect()} == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(x) for x in repair.repair_damaged(df).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_rows_and_long_texts(spark):
    long = "word " * 200_000
    rows = [(7, 3, "user", "Same.")] * 3000 + [(7, t, "user", "Same.") for t in range(100, 400)] + [(7, None, "assistant", long + "."), (8, 1, "user", long), (8, 2, "assistant", long + "!")]
    got = {r.conv_id: r for r in repair.repair_damaged(spark.createDataFrame(rows, ROW)).collect()}
    want = {x[0]: x for x in sql(spark.createDataFrame(rows, ROW))}
    assert {c: tuple(r) for c, r in got.items()} == want
    assert got[7].duplicate >= 3000 and len(got[7].audit) >= 3000


def test_no_rows_left_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], ROW)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", NOTHING)]
    assert repair.repair_damaged(spark.createDataFrame([], ROW)).collect() == []


@pytest.mark.parametrize("rows,cost,edits", [
    ([("user", "Hi."), ("assistant", "Yes.")], 0, "KK"), ([("system", "Be.")], 2, "D"), ([("system", "Be."), ("user", "Hi.")], 2, "RR"),
    ([("user", "Hi."), ("user", "Ho."), ("assistant", "Yes.")], 2, "DKK"), ([("user", "Hi."), ("user", "Ho.")], 1, "KR"), ([("user", "a."), ("assistant", "b."), ("user", "c."), ("assistant", "d")], 4, "KKDD"),
])
def test_single_repairs(spark, rows, cost, edits):
    df = spark.createDataFrame([(1, i, r, t, 1) for i, (r, t) in enumerate(rows)], ROW + ", copies long")
    got = repair.repair(df).first()
    assert (got.cost, got.audit) == (cost, edits)


def test_query_against_sql(spark):
    got = {tuple(r) for r in queries.op13_conversation_repair(spark, SF).collect()}
    assert got == sql(spark.read.parquet(f"{SF}/conversations.parquet")) and len(got) > 10
