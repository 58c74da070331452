"""The pipeline's stages on odd rows and against brute force, and the whole of it on the smallest tables."""

import os
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from patchlight.llm import decontamination, language, mixing, neardup
from patchlight.llm.common import materialise, scratch

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
ODD = [
    (1, None, "en", None, 0), (2, "", "en", "s", 0), (3, "!!! 123", "de", "t", 7), (None, "some words of no key here", None, "s", 25), (5, "word " * 30000, "en", "t", 150000), (6, "x" * 300000, None, None, 300000),
    (7, "tie one two three four five six", "fr", "s", 31), (8, "tie one two three four five six", "fr", "u", 31), (9, "again and again the same row", "en", "u", 28), (9, "again and again the same row", "en", "u", 28),
]
CLASHES = ["__id", "__node", "__one", "__j", "node", "id", "key", "root", "class_id", "kept", "shard", "size", "words", "d", "t", "k", "start", "judged", "__text_hash", "__part", "__first", "text_hash", "part", "n_words", "contaminated"]


def odd(spark):
    """Odd rows whose further columns have the names that stages may use for their own."""
    return spark.createDataFrame(ODD, SHAPE).withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


def shown(rows, names):
    return Counter(tuple(r[c] for c in names) for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, name):
    docs, last = odd(spark), name == corpus_pipeline.STAGES[-1][0]
    out = STAGES[name](spark, docs, SF)
    rows = out.collect()
    if not last:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert {r[c] for r in rows for c in ("n_words", "contaminated", "__part")} == {"mine n_words", "mine contaminated", "mine __part"}
    assert {r["__id"] for r in rows} == {"mine __id"} and {r["judged"] for r in rows} == {"mine judged"}
    got = Counter(r.doc_id for r in rows)
    if name == "language ID":  # no letters, no language
        assert not got.keys() & {1, 2, 3} and got[9] in (0, 2)
    if name == "near-dedup":  # one of equal texts
        assert got == Counter([1, 2, 3, None, 5, 6, 7, 9])
    if name in ("decontamination", "sharding"):
        assert got == Counter(r[0] for r in ODD)
    if name == "mixing":  # texts without words are in no block
        assert not got.keys() & {1, 2}
    empty = STAGES[name](spark, docs.where("false"), SF)
    assert empty.collect() == [] and (last or empty.columns == docs.columns)


def test_mixing_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs)
    target = {r.source: r.target for r in mixed.sources.collect()}
    text, of, got, times = {}, {}, defaultdict(int), Counter()
    for r in docs.collect():
        text[r.doc_id], of[r.doc_id] = r.text or "", r.source
    whole = Counter()
    for r in mixing.apply(docs).collect():
        n = len(re.findall(mixing.WORD, r.text))
        got[r.source] += n
        times[r.doc_id] += 1
        assert text[r.doc_id].startswith(r.text) and r.source == of[r.doc_id] and (r.text == text[r.doc_id] or r.n_chars == len(r.text))
        whole[r.source] += r.text != text[r.doc_id]
    assert all(abs(got[s] - t) <= 1 for s, t in target.items()) and max(times.values()) <= 3
    assert all(n <= 1 for n in whole.values())  # at most one document a source is cut


def test_schedule_agrees_with_what_is_taken(spark):
    """What the slots' blocks hold, read word by word, is what documents are said to give."""
    rows = [(i, " ".join(f"w{i}" for _ in range(i * 7 % 23)), None, "abc"[i % 3], 0) for i in range(90)]
    mixed = mixing.mix(spark.createDataFrame(rows, SHAPE), block_words=16)
    laid = defaultdict(dict)
    for d in mixed.documents.collect():
        for w in range(d.size):
            laid[d.source_no][d.start + w] = d.doc_id
    taken = Counter()
    slots = mixed.slots.collect()
    for s in slots:
        taken.update(laid[s.source_no][s.block * 16 + w] for w in range(s.words))
    assert len({s.slot for s in slots if s.words}) and {d.doc_id: d.taken for d in mixed.documents.collect()} == {d.doc_id: taken[d.doc_id] for d in mixed.documents.collect()}


def test_whole_pipeline(spark):
    """The stages one by one, each against what its operator says of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        with scratch(spark):
            kept = materialise(stage(spark, step, SF), "test-stage", keep=True)
            before = {r.doc_id for r in step.collect()}
            after = {r.doc_id for r in kept.collect()}
            if name == "language ID":
                told = language.predict(step, language.train(step.where(~language.held_out(step)))).collect()
                want = {r.doc_id for r in told if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
            elif name == "near-dedup":
                want = {r.doc_id for r in neardup.classes(step).where("kept").collect()}
            elif name == "decontamination":
                want = {r.doc_id for r in decontamination.contamination(step, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated").collect()}
            else:
                want = {r.doc_id for r in mixing.digest(mixing.mix(step)).where("taken > 0").collect()}
        assert after == want and after <= before, name
        step = kept
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in step.collect())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_pipeline_is_a_query():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and list(STAGES) == ["language ID", "near-dedup", "decontamination", "mixing", "sharding"]


def test_scratch_deletes_what_it_made(spark, tmp_path):
    import os

    with scratch(spark):
        gone, stays = materialise(spark.range(3), "gone"), materialise(spark.range(4), "stays", keep=True)
        path = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and stays.count() == 4


def unevenness(spark, docs, path):
    """How far the parts of words that sources have, in the corpus as it is written, are from the whole's, at any eighth of it."""
    mixing.apply(docs).write.parquet(path)
    files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet"))
    rows = [(r["source"], len(re.findall(mixing.WORD, r["text"]))) for f in files for r in pq.read_table(f, columns=["source", "text"]).to_pylist()]
    total = Counter()
    for s, n in rows:
        total[s] += n
    words, seen, at, worst = sum(total.values()), Counter(), 0, 0.0
    for s, n in rows:
        seen[s] += n
        at += n
        if at >= words / 8:
            worst = max(worst, *(abs(seen[k] / at - total[k] / words) for k in total))
    return worst


def test_every_prefix_of_the_corpus_is_mixed(spark, tmp_path, monkeypatch):
    rows = [(i, f"word{i} " * (5 + i % 40), "en", "abcd"[min(3, i % 7)], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SHAPE)
    assert unevenness(spark, docs, str(tmp_path / "golden")) < 0.08  # an eighth has some 9000 words, a block 512
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    assert unevenness(spark, docs, str(tmp_path / "none")) > 0.15


def test_slots_of_documents(spark):
    """A document's slots are those whose blocks hold its first word, each time that its source begins again."""
    rows = [(i, " ".join(f"w{i}" for _ in range(i * 7 % 23)), None, "abc"[i % 3] if i % 5 else "abc"[0], 0) for i in range(90)]
    mixed = mixing.mix(spark.createDataFrame(rows, SHAPE), block_words=16)
    slots = mixed.slots.collect()
    for d in mixed.documents.collect():
        want = sorted(s.slot for s in slots if d.size and s.source_no == d.source_no and s.block == d.start // 16 and s.block * 16 + s.words > d.start)
        assert d.slots == want and (not d.taken or d.slots)
