"""Token files: coding, cutting and checksums by brute force, and exact round trips of tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlight.llm import queries, token_files
from patchlight.llm.common import scratch, scratch_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def expected(rows, end=2):
    """rows of (key, text) in their order: (key, start, n_tokens, ids_crc32)."""
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000, 70000, 140001])
def test_blocks_decode_from_every_checkpoint(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 40000)
    freqs = token_files.quantised({int(k): int(v) for k, v in zip(*np.unique(ids, return_counts=True))})
    coder = token_files.Coder(freqs, token_files.BITS)
    lanes, states, marks, words = coder.encode(ids)
    assert len(states) == len(marks) == -(-(-(-n // lanes)) // token_files.CHECKPOINT)
    for k in range(len(states)):
        assert (coder.decode(n, states, marks, words, k) == ids[k * token_files.CHECKPOINT * lanes :]).all()
    p = freqs[ids] / 2**token_files.BITS
    assert 4 * len(words) + 8 * lanes <= -np.log2(p).sum() / 8 * 1.01 + 12 * lanes + 8  # close to what the frequencies allow
    if len(words):
        bad = words.copy()
        bad[len(bad) // 2] ^= 1
        try:
            changed = coder.decode(n, states, marks, bad)
        except ValueError:
            pass
        else:
            assert (changed != ids).any()


def test_frequencies_sum_to_the_whole():
    for counts in ({5: 1}, {0: 10**15, 9: 1}, {i: 1 for i in range(49408)}, {i: 1 + (i == 3) * 10**12 for i in range(60000)}):
        f = token_files.quantised(counts)
        assert f.sum() == 1 << token_files.BITS and all(f[i] >= 1 for i in counts) and (f > 0).sum() == len(counts)


def test_checksums_of_pieces():
    r = random.Random(1)
    for _ in range(50):
        parts = [r.randbytes(r.choice([0, 1, 3, 1000])) for _ in range(r.randint(1, 5))]
        assert token_files.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZé ß.,:;!?'’s\n\t\r\u0085 ́İΣς…-_0９<|>#漢\x00🙂")) | st.characters(exclude_categories=["Cs"]), max_size=40) | st.sampled_from(["<|endoftext|>", "don't. 's a<|startoftext|> b", " ", "\n\n", "A.B ,c"]), max_size=8))
def test_chunks_give_the_ids_of_whole_texts(texts):
    column = pa.array(["skipped", *texts], pa.string()).slice(1)
    ids, n = token_files._ids(column, PATH, False, np.dtype("<u2"))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZéßÀÿ×÷ñ.!#$%&*+'-\x01\u0301\u0338ªµÐþĀſ 9|<")), max_size=30) | st.sampled_from(["été&&& Straße###", "3×! a÷. b×& Ñ%<|endoftext|>%", "L'été*'s"]), max_size=8))
def test_marks_after_letters_of_latin_1_part_chunks(texts):
    ids, n = token_files._ids(pa.array(texts, pa.string()), PATH, False, np.dtype("<u2"))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == want


def test_words_are_encoded_many_at_a_time():
    """A word with other marks after it is the word that is known; words of letters are joined, and what isn't one word to the tokenizer is left."""
    parts, each = token_files.chunks(pa.array(["été&&& a### 3×!", "a$ b÷."], pa.string()))
    assert parts.to_pylist() == ["été", "&&&", "a", "###", "3×!", "a", "$", "b÷."] and each.tolist() == [5, 3]
    t, known = Tokenizer.from_file(PATH), {}
    words = ["Ämter", "été", "ÿ"] * 200
    assert token_files._encode_joined(token_files._joining(PATH, False), words, words, np.dtype("<u2"), known) == []
    assert {w: np.frombuffer(x, "<u2").tolist() for w, x in known.items()} == {w: t.encode(w, add_special_tokens=False).ids for w in words[:3]}
    assert token_files._encode_joined(token_files._joining(PATH, False), ["a&b"], ["a&b"], np.dtype("<u2"), known) == ["a&b"]


@pytest.mark.parametrize("block_size", [1, 7, 300, token_files.BLOCK])
def test_round_trip_of_odd_rows(spark, block_size):
    long = "word " * 3000 + "tail"
    rows = [(5, "one, two. three"), (-3, None), (2, ""), (2, ""), (None, "no key"), (9, long if block_size > 1 else "short"), (7, "#hash ends # #"), (2, "tie"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("mine") for n in ("key", "ids", "file", "tie", "n_tokens", "start")}).repartition(3)
    got = sorted((tuple(r) for r in token_files.round_trip(docs, PATH, by_chunks=True, block_size=block_size).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -3, 2, 2, 2, 5, 7, 9]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert sorted((r[0] is None, r[0] or 0, *r[2:]) for r in got) == sorted((r[0] is None, r[0] or 0, *r[2:]) for r in expected(rows))


def test_whole_texts_and_other_keys(spark):
    rows = [(f"k{i:03}", f"text {i} of " + "many words, " * (i % 7)) for i in range(100)]
    docs = spark.createDataFrame(rows, "id string, body string").repartition(4)
    got = token_files.round_trip(docs, PATH, key="id", text="body", block_size=50).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_empty_table_and_no_end_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(empty, PATH).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "c")], "doc_id long, text string")
    with scratch(spark):
        folder = scratch_folder(spark, "t")
        token_files.write(docs, folder, PATH, end=None)
        found = token_files.pieces(spark, folder, with_ids=True).orderBy("file", "at").collect()
        t = Tokenizer.from_file(PATH)
        assert [(r["key"], r["ids"]) for r in found] == [(1, t.encode("a b").ids), (4, t.encode("c").ids)]


def test_damaged_blocks_are_told(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    with scratch(spark):
        folder, bad = scratch_folder(spark, "t"), scratch_folder(spark, "t")
        token_files.write(docs, folder, PATH)
        spark.read.parquet(f"{folder}/frequencies").write.parquet(f"{bad}/frequencies")
        spark.read.parquet(f"{folder}/blocks").withColumn("crc32", F.col("crc32") + 1).write.parquet(f"{bad}/blocks")
        with pytest.raises(Exception, match="checksum differs"):
            token_files.pieces(spark, bad).collect()


def test_query_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op11_token_files(spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected([(r.doc_id, r.text) for r in docs])
