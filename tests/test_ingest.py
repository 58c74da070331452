"""CSV in splits, recorded searches and details, saving in batches, calls of services."""

import asyncio
import csv
import io
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from patchlight.operators import calling
from patchlight.sources import csv_splits, recorded
from patchlight.streaming import saving


@pytest.fixture
def splits_of(spark):
    """Sets the size of splits, down to a few bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.execution.arrow.maxRecordsPerBatch"]

    def set_to(n, batch=10000):
        for name, v in zip(names, (n, 0, 1, batch)):
            spark.conf.set(name, str(v))

    yield set_to
    for name in names:
        spark.conf.unset(name)


def shown(rows):
    """Rows in order; an empty field is read as null."""
    return sorted((tuple(v or "" for v in r) for r in rows))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [40, 1000, 1 << 20])
def test_csv_in_splits(spark, tmp_path, splits_of, end, split):
    r = random.Random(split)
    fields = ["plain", "", "a,b", 'say "hi"', "two\nlines", "cr\r\nlf", '"', '""', "\n", "é漢🙂", "x" * 90, ',"\n",', "\n\n\n" + "y" * 40, " spaced "]
    want = []
    for name in ("a", "b", "only-header"):
        rows = [[str(i), r.choice(fields), r.choice(fields)] for i in range(30 if name != "only-header" else 0)]
        out = io.StringIO()
        csv.writer(out, lineterminator=end).writerows([["id", "te\nxt", "more"], *rows])
        (tmp_path / f"{name}.csv").write_bytes((out.getvalue().rstrip("\r\n") if name == "b" else out.getvalue()).encode())
        want += rows
    splits_of(split, 5 if split == 1000 else 10000)
    found = csv_splits.read(spark, str(tmp_path), "id string, text string, more string")
    assert shown(found.collect()) == shown(want)
    splits_of(1 << 27)
    assert csv_splits.read(spark, str(tmp_path), "id string, text string, more string", header=False).count() == len(want) + 3


def test_one_record_over_many_splits(spark, tmp_path, splits_of):
    long = "line\n" * 400
    (tmp_path / "x.csv").write_text(f'id,text\n1,"{long}"\n2,short\n3,"{long}"')
    splits_of(100)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    assert sorted(map(tuple, csv_splits.read(spark, str(tmp_path), "id int, text string").collect())) == [(1, long), (2, "short"), (3, long)]


def test_csv_of_nothing(spark, tmp_path, splits_of):
    (tmp_path / "empty.csv").write_text("")
    assert csv_splits.read(spark, str(tmp_path), "id int").collect() == []
    (tmp_path / "open.csv").write_text('id,t\n1,"never closed\nto the end')
    (tmp_path / "blank.csv").write_text("id,t\n\n5,x\n\nbad,y\n")
    assert sorted(map(str, csv_splits.read(spark, str(tmp_path), "id int, t string").collect())) == ["Row(id=1, t='never closed\\nto the end')", "Row(id=5, t='x')", "Row(id=None, t='y')"]


def _write_pages(root, pages):
    for (keyword, page), items in pages.items():
        at = root / f"search_keyword={keyword}" / f"page={page}"
        at.mkdir(parents=True)
        (at / "part-0.txt").write_text(items if isinstance(items, str) else json.dumps({"total_count": 1000, "items": items}))


def hits(n, start=0):
    return [{"number": start + i, "title": f"t{start + i}", "html_url": f"u/{start + i}", "user": {"login": "l"} if i % 2 else None} for i in range(n)]


def test_search_ends_as_a_live_one_would(spark, tmp_path):
    full = {(k, p): hits(30, 30 * p) for k in ("quota", "all") for p in range(1, 13)}
    _write_pages(tmp_path, full | {("short", 1): hits(30), ("short", 2): hits(4, 30), ("short", 3): hits(30, 60), ("gap", 1): hits(30), ("gap", 3): hits(30, 60), ("none", 1): [], ("none", 2): hits(3), ("broken", 1): "{nope", ("a%2Fb c", 1): hits(2)})
    found = recorded.search(spark, str(tmp_path))
    count = {r.search_keyword: r["count"] for r in found.groupBy("search_keyword").count().collect()}
    assert count == {"quota": 300, "all": 300, "short": 34, "gap": 30, "a/b c": 2}
    some = recorded.search(spark, "file:" + str(tmp_path), quota=40, keywords=["quota", "short"])
    assert sorted((r.search_keyword, r.number) for r in some.collect()) == [("quota", 30 + i) for i in range(40)] + [("short", i) for i in range(34)]


def test_a_partition_for_each_page(spark, tmp_path):
    _write_pages(tmp_path, {(k, p): hits(30) for k in ("a", "b", "c") for p in (1, 2, 3, 4)})
    spark.dataSource.register(recorded.RecordedSearch)
    df = spark.read.format("recorded_search").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 12 and df.count() == 360
    assert df.schema.simpleString().startswith("struct<search_keyword:string,page:int")


def test_details_lose_no_row(spark):
    ok = json.dumps({"number": 1, "title": "T", "body": None, "state": "open", "user": {"login": "me"}, "merged_by": None, "patch": "+x", "extra": [1]})
    url = "https://h.example/o/r/pull/{}"
    changes = spark.createDataFrame([(i, u) for i, u in enumerate([url.format(1), url.format(2), url.format(3), url.format(4), url.format(5), None, "https://h.example/about", url.format(1), "HTTPS://h.example/O/R/pull/6", url.format(7) + "/files?w=1", url.format(77)])], "id int, html_url string").withColumn("key", F.lit("mine"))
    answers = [(url.format(1), 200, ok), (url.format(1), 404, "{}"), (url.format(2), 404, None), (url.format(3), 200, ok[:30]), (url.format(4), 403, ok), (url.format(6), 200, ok), (url.format(7), 200, ok.replace('"number": 1', '"number": {}')), (None, 200, ok), ("nothing", 200, ok)]
    found = recorded.details(changes, spark.createDataFrame(answers, "url string, status int, body string")).orderBy("id").collect()
    assert [r.outcome for r in found] == ["ok", "not_found", "broken", "refused", "missing", "no_change", "no_change", "ok", "no_change", "broken", "missing"]
    assert found[0].pr_title == "T" and found[0].pr_description == "" and found[0].pr_user == "me" and found[0].pr_merged_by is None and found[0].patch_text == "+x"
    assert all(r.pr_title is None for r in found if r.outcome != "ok") and all(r.key == "mine" for r in found)


def test_answers_that_are_no_json_keep_their_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"url": "u", "status": 200, "body": "{}"}\nnot json\n')
    found = recorded.read_answers(spark, str(tmp_path)).collect()
    assert sorted((str(r.url), str(r.unreadable)) for r in found) == [("None", "not json"), ("u", "None")]


class Killed(Exception):
    pass


@pytest.mark.parametrize("where", ["work", "commit"])
def test_a_killed_batch_is_saved_once(spark, tmp_path, where):
    source, target, shape = str(tmp_path / "in"), str(tmp_path / "out"), "k long, v string"
    spark.range(200).selectExpr("id AS k", "concat('v', id) AS v").repartition(8).write.parquet(source)
    calls = []

    def work(batch):
        calls.append(batch.count())
        if where == "work" and len(calls) == 3:
            raise Killed("killed in the middle")
        return batch

    def stop(number):
        if where == "commit" and len(calls) == 3:
            raise Killed("killed in the middle")

    with pytest.raises(Exception, match="killed in the middle"):
        saving.save(spark, source, shape, target, work, files_per_batch=2, before_commit=stop)
    before = saving.saved(spark, target, shape)
    assert saving.commits(spark, target).count() == 2 and before.count() == sum(calls[:2]) < 200
    left = saving.remaining(spark.range(200).withColumnRenamed("id", "k"), spark, target, shape, "k")
    assert left.count() == 200 - before.count()
    saving.save(spark, source, shape, target, work, files_per_batch=2)
    rows = saving.saved(spark, target, shape)
    assert sorted(r.k for r in rows.collect()) == list(range(200)) and rows.select("batch").distinct().count() == 4
    assert sum(calls) == 200 + calls[2]  # only the batch that was killed is worked on again
    # new files are new batches, and a run without any changes nothing
    spark.range(200, 210).selectExpr("id AS k", "'new' AS v").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        saving.save(spark, source, shape, target, files_per_batch=2)
    assert saving.saved(spark, target, shape).count() == 210 and saving.commits(spark, target).count() == 5


def test_nothing_saved_yet(spark, tmp_path):
    assert saving.saved(spark, str(tmp_path), "k long").columns == ["k", "batch"]
    assert saving.remaining(spark.range(3).withColumnRenamed("id", "k"), spark, str(tmp_path), "k long", "k").count() == 3


def test_calls_are_bounded_and_have_deadlines(spark, tmp_path):
    log = tmp_path / "log"

    def make():
        running = 0

        async def client(row):
            nonlocal running
            running += 1
            with log.open("a") as f:
                f.write(f"{os.getpid()} {running}\n")
            try:
                await asyncio.sleep(9 if row["prompt"] == "slow" else 0.02)
                if row["prompt"] == "bad":
                    raise ValueError("x" * 500)
                return row["prompt"] + row["extra"]
            finally:
                running -= 1

        return client

    prompts = ["fine", "slow", "bad", None, "last"] * 8
    df = spark.createDataFrame([(i, p, "!") for i, p in enumerate(prompts)], "id int, p string, extra string").coalesce(2)
    began = time.time()
    got = sorted(calling.ask(df, F.col("p"), make, send=("extra",), concurrency=4, deadline=0.3).collect(), key=lambda r: r.id)
    assert time.time() - began < 20
    want = {"fine": ("fine!", "ok", None), "last": ("last!", "ok", None), "slow": (None, "timeout", "Timeout after 0.3 seconds"), "bad": (None, "error", "x" * 200), None: (None, None, None)}
    assert [(r.id, r.p, (r.answer, r.outcome, r.message)) for r in got] == [(i, p, want[p]) for i, p in enumerate(prompts)]
    under_way = [int(x.split()[1]) for x in log.read_text().splitlines()]
    assert len(under_way) == 32 and max(under_way) == 4


def test_plain_functions_as_clients(spark):
    def client(row):
        if row["prompt"] == "slow":
            time.sleep(2)
        return row["prompt"].upper()

    df = spark.createDataFrame([("a",), ("slow",), ("b",)], "p string").coalesce(1)
    got = {r.p: (r.answer, r.outcome) for r in calling.ask(df, F.col("p"), lambda: client, deadline=0.5).collect()}
    assert got == {"a": ("A", "ok"), "b": ("B", "ok"), "slow": (None, "timeout")}
    assert calling.ask(df.where("false"), F.col("p"), lambda: client).collect() == []


def test_two_agents_give_the_records(spark):
    """A first agent that sleeps, fails and answers, and one that reviews what it is shown."""
    answer = json.dumps({"is_type_related": True, "confidence": 0.5, "reasoning": "because", "evidence": ["e"], "detected_in": {"title": True}})

    async def first(row):
        if row["recorded_outcome"] == "timeout":
            await asyncio.sleep(60)
        if row["recorded_outcome"] == "error":
            raise ConnectionError("refused")
        return "no json" if row["recorded_outcome"] == "broken" else answer

    async def second(row):
        assert row["recorded_outcome"] != "error"
        if row["recorded_outcome"] == "late review":
            await asyncio.sleep(60)
        seen = "because" if "Reasoning: because" in row["prompt"] else "late" if "Timeout after 0.2 seconds" in row["prompt"] else "nothing"
        return json.dumps({"validation_result": "APPROVED", "agreed_classification": True, "validator_confidence": 1, "validator_reasoning": seen})

    kinds = ["ok", "timeout", "error", "broken", "late review"]
    shown = "title string, body string, commit_messages string, patch_text string, additions long, deletions long, files long"
    df = spark.createDataFrame([(i, k, "T", None, None, "+x", 1, 0, 1) for i, k in enumerate(kinds)], "id int, recorded_outcome string, " + shown)
    got = {r.recorded_outcome: r for r in calling.two_agents(df, "TypeScript", lambda: first, lambda: second, ("recorded_outcome",), deadline=0.2).collect()}
    r = got["ok"]
    assert (r.classifier_is_type_related, r.validation_result, r.validator_reasoning, r.final_is_type_related, r.error, r.detected_in_title) == (True, "APPROVED", "because", True, False, True)
    r = got["timeout"]
    assert (r.classifier_is_type_related, r.classifier_reasoning, r.validation_result, r.validator_reasoning, r.final_is_type_related, r.error) == (False, "Timeout after 0.2 seconds", "APPROVED", "late", False, False)
    r = got["error"]
    assert (r.classifier_reasoning, r.validation_result, r.final_is_type_related, r.error) == ("Classifier API error", "ERROR", False, True)
    assert (got["broken"].classifier_is_type_related, got["broken"].validator_reasoning) == (False, "nothing")
    assert (got["broken"].validation_result, got["late review"].validation_result, got["late review"].final_is_type_related) == ("APPROVED", "UNCERTAIN", False)
    assert "patch_text" not in got["ok"].asDict()
