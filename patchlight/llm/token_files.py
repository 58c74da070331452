"""Token ids as files: range asymmetric numeral coding of interleaved blocks by a shared table of frequencies.

A folder holds two tables. `frequencies` has (id, freq, bits, width): the freqs of all ids sum to 2**bits. `blocks` has a row for each
block, which decodes by itself: its ids are dealt over `lanes` in turn, each lane is a coder of its own, and `words` holds
what the lanes put out, in the order in which decoding takes it. `states` and `marks` are its checkpoints (all lanes'
states and the place in `words`, every CHECKPOINT rounds): decoding can begin at any. `crc32` is that of the block's ids.
`keys`, `lengths`, `doc_nos`, `piece_nos` and `lasts` list the pieces of documents that the block holds, in order.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlight.llm.common import materialise, scratch, scratch_folder

#: Ids of a block, its coders at most, and rounds (an id for each coder) between its checkpoints.
BLOCK, LANES, CHECKPOINT = 1 << 18, 1024, 128
#: Frequencies sum to two to the power of so many bits (more for vocabularies of over 2**17 ids).
BITS = 20
#: Coders' states stay from here to below 2**63, and put out 32 bits at a time.
LOW = np.uint64(1 << 31)
#: Chunks of texts whose ids a task remembers, at most; beyond, it starts anew.
REMEMBERED = 400_000
#: Bytes of texts that are cut into chunks at a time, about (a longer text is one slice).
SLICE = 1 << 24
#: So many words are encoded as one text, with this between them: an encoding costs more than a word's ids.
JOINED, _BETWEEN = 256, "\x01"
#: Words of these letters are one each to a tokenizer by chunks: no other letters come or go when they are normalised.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_U32, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


class Coder:
    """Encodes and decodes blocks of ids by frequencies that sum to 2**bits; freqs[i] is the id i's, 0 if it never occurs."""

    def __init__(self, freqs: np.ndarray, bits: int):
        self.bits, self.freqs = np.uint64(bits), freqs.astype(np.uint64)
        self.begins = (np.cumsum(self.freqs) - self.freqs).astype(np.uint64)
        self.ids = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(lanes, states at each checkpoint, marks, words) of at least one id. The last round is filled up with the block's last id."""
        lanes = min(LANES, 1 << max(0, len(ids) // 64).bit_length())
        rounds = -(-len(ids) // lanes)
        s = np.full(rounds * lanes, ids[-1], np.int64)
        s[: len(ids)] = ids
        s = s.reshape(rounds, lanes)
        x, out, states, marks, n = np.full(lanes, LOW), [], [], [], 0
        spare = np.uint64(63) - self.bits
        for t in range(rounds - 1, -1, -1):
            f = self.freqs[s[t]]
            over = np.flatnonzero(x >= f << spare)
            if len(over):
                out.append((x[over] & _U32).astype(np.uint32))
                x[over] >>= _32
                n += len(over)
            q = x // f
            x = (q << self.bits) + (x - q * f) + self.begins[s[t]]
            if t % CHECKPOINT == 0:
                states.append(x.copy())
                marks.append(n)
        words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
        return lanes, np.stack(states[::-1]), n - np.array(marks[::-1], np.int64), words

    def decode(self, n: int, states: np.ndarray, marks: np.ndarray, words: np.ndarray, checkpoint: int = 0) -> np.ndarray:
        """The ids of a block of n from one of its checkpoints on."""
        lanes, mask = states.shape[1], (np.uint64(1) << self.bits) - np.uint64(1)
        rounds, x, at = -(-n // lanes), states[checkpoint].copy(), int(marks[checkpoint])
        out = np.empty((rounds - checkpoint * CHECKPOINT, lanes), np.uint32)
        for t in range(len(out)):
            slot = x & mask
            s = self.ids[slot]
            out[t] = s
            x = self.freqs[s] * (x >> self.bits) + slot - self.begins[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                if at + len(low) > len(words):
                    raise ValueError("a block of token ids is damaged: its words don't suffice")
                x[low] = (x[low] << _32) | words[at : at + len(low)]
                at += len(low)
        if at != len(words) or (x != LOW).any():
            raise ValueError("a block of token ids is damaged: its coders don't end where they began")
        return out.ravel()[: n - checkpoint * CHECKPOINT * lanes]


def quantised(counts: dict[int, int], bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, in proportion to counts, at least 1 for each id that occurs."""
    freqs, total, whole = np.zeros(max(counts) + 1, np.int64), sum(counts.values()), 1 << bits
    for i, c in counts.items():
        freqs[i] = max(1, c * whole // total)
    over = int(freqs.sum()) - whole
    for i in np.argsort(-freqs, kind="stable"):  # what rounding leaves goes to, or comes from, the most frequent
        if over <= 0:
            freqs[i] -= over
            break
        less = min(over, int(freqs[i]) // 2)
        freqs[i] -= less
        over -= less
    return freqs


def crc32_joined(pieces: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes of which only (CRC-32, length) of the consecutive pieces are known.

    A checksum goes on over zero bytes by a linear map of its bits, which is squared for every further bit of the length.
    """

    def times(m: list[int], v: int) -> int:
        s = 0
        for row in m:
            if v & 1:
                s ^= row
            v >>= 1
        return s

    crc = 0
    for c, n in pieces:
        step = [zlib.crc32(b"\0", 1 << i ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(32)]  # one zero byte, without the inversions
        while n:
            if n & 1:
                crc = times(step, crc)
            step = [times(step, row) for row in step]
            n >>= 1
        crc ^= c
    return crc


_tokenizers: dict[str, tuple[object, object, object, dict[str, bytes]]] = {}
_KINDS = np.zeros(256, np.uint8)
_KINDS[[10, 32]] = 1
_KINDS[list(b"!,.:;?#$%&*")] = 2
_KINDS[65:91] = _KINDS[97:123] = 3


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut at spaces and line feeds (which are left out) and between a letter (A-Z, À-ÿ) and one of !,.:;?#$%&* after it; and how many chunks each text has.

    A tokenizer of the kind that tokens() calls by_chunks gives a text's ids chunk by chunk.
    """
    first, n = texts.offset, len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[first : first + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    kind = _KINDS[data]
    gap = kind == 1
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = gap
    mark = np.flatnonzero(kind[1:] == 2) + 1
    before = data[mark - 1]
    far = (data[np.maximum(mark, 2) - 2] == 0xC3) & (before & 0xC0 == 0x80) & (before & 0xDF != 0x97)  # À-ÿ in UTF-8, without the signs of times and division
    cut[mark[(kind[mark - 1] == 3) | far]] = True
    cut[at] = True
    places = np.flatnonzero(cut)
    # an empty text has no chunk of its own
    each = np.searchsorted(places, at[1:]) - np.searchsorted(places, at[:-1])
    kept = places - np.searchsorted(np.flatnonzero(gap), places)
    return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(kept), pa.py_buffer(data[~gap])), each


def _joining(path: str, lower: bool) -> object:
    """A tokenizer for words with _BETWEEN between them. lower: they are A-Z in lower case, which nothing else changes."""
    from tokenizers import Tokenizer, pre_tokenizers

    made, between = Tokenizer.from_file(path), pre_tokenizers.CharDelimiterSplit(_BETWEEN)
    made.no_truncation()
    made.no_padding()
    if lower:
        made.normalizer, made.pre_tokenizer = None, between
    else:
        made.pre_tokenizer = pre_tokenizers.Sequence([between, made.pre_tokenizer] if made.pre_tokenizer else [between])
    return made


def _encode_joined(by, words: list[str], given: list[str], dtype: np.dtype, known: dict[str, bytes]) -> list[str]:
    """Adds words' ids to known, as by, a _joining() tokenizer, tells them of what is given for each. Returns words that it didn't take as one each."""
    left = []
    for i in range(0, len(words), JOINED):
        some = words[i : i + JOINED]
        e = by.encode(_BETWEEN.join(given[i : i + JOINED]), add_special_tokens=False)
        n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
        if len(n) != len(some) or not n.all():
            left += some
            continue
        ids, ends = np.array(e.ids, dtype).tobytes(), np.cumsum(n) * dtype.itemsize
        at = [0, *ends.tolist()]
        known.update(zip(some, [ids[lo:hi] for lo, hi in zip(at, at[1:])]))
    return left


def _ids(texts: pa.Array, path: str, whole: bool, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, and how many each has. Each different chunk is encoded once."""
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path), _joining(path, True), _joining(path, False), {}
    tokenizer, lower, any_case, known = _tokenizers[path]
    if whole:
        found = [np.array(e.ids, dtype) for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(found) if found else np.empty(0, dtype), np.array([len(x) for x in found], np.int64)
    parts, each = chunks(texts)
    held = parts.dictionary_encode()
    words, which = held.dictionary.to_numpy(zero_copy_only=False).tolist(), held.indices.to_numpy()
    del parts, held
    new = [w for w in words if w not in known]
    if len(known) + len(new) > REMEMBERED:
        kept = {w: known[w] for w in words if w in known}
        known.clear()
        known.update(kept)
    plain, letters, others = [], [], []
    for w in new:
        (others if not _LETTERS.fullmatch(w) else plain if w.isascii() else letters).append(w)
    others += _encode_joined(lower, plain, [w.lower() for w in plain], dtype, known) + _encode_joined(any_case, letters, letters, dtype, known)
    for i in range(0, len(others), 4096):
        for w, e in zip(others[i : i + 4096], tokenizer.encode_batch_fast(others[i : i + 4096], add_special_tokens=False)):
            known[w] = array(dtype.char, e.ids).tobytes()
    codes = [known[w] for w in words]
    sizes = np.array([len(c) for c in codes], np.int32) // dtype.itemsize
    flat, begins = np.frombuffer(b"".join(codes), dtype), np.cumsum(sizes, dtype=np.int32) - sizes
    n = sizes[which]
    ends = np.cumsum(n, dtype=np.int32)
    at = np.repeat(begins[which] - ends + n, n)
    at += np.arange(len(at), dtype=np.int32)
    out = flat[at]
    ends, last = np.r_[0, ends], np.cumsum(each)
    return out, ends[last] - ends[last - each]


def tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = 2, by_chunks: bool = False) -> tuple[DataFrame, int]:
    """((key, ids), bytes an id) of all texts: ids as little-endian numbers of 2 or 4 bytes, with the end id after each text. A null text is an empty one.

    by_chunks: the tokenizer drops white space, parts words from punctuation and lowers A-Z, so equal chunks of texts need encoding only once.
    """
    from tokenizers import Tokenizer

    dtype = np.dtype("<u2" if max(Tokenizer.from_file(path).get_vocab_size(), (end or 0) + 1) <= 1 << 16 else "<u4")
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = max(1, len(b) * SLICE // max(b.nbytes, 1))
            for lo in range(0, len(b), rows):
                part = b.slice(lo, rows)
                ids, n = _ids(part.column("text"), path, not by_chunks, dtype)
                if end is not None:
                    ids = np.insert(ids, np.cumsum(n), end)
                    n = n + 1
                at = np.r_[0, np.cumsum(n)] * dtype.itemsize
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("key"), made.cast(pa.binary())], ["key", "ids"])

    return docs.mapInArrow(encoded, T.StructType([docs.schema["key"], T.StructField("ids", T.BinaryType())])), dtype.itemsize


def _numbers(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data.view(dtype), np.diff(at) // dtype.itemsize


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int | None = 2, by_chunks: bool = False, block_size: int = BLOCK) -> None:
    """Writes the ids of all texts to a new folder, in ascending order of keys (null first; of one key by a hash of the ids).

    Texts are encoded once, to an intermediate table from which ids are counted, all of them, and then put in order by
    range: a partition's blocks are one file of the order. A document may span any number of blocks. Of repeated rows each
    is written. No task holds more than a block of
    block_size ids and an Arrow batch; a longer document comes as one row, as in the input.
    """
    spark = docs.sparkSession
    with scratch(spark):
        ids, width = tokens(docs, path, key, text, end, by_chunks)
        ids, dtype = materialise(ids, "tokens-ids", compression="zstd"), np.dtype(f"<u{width}")

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(0, np.int64)
            for b in batches:
                if len(b):
                    c = np.bincount(_numbers(b.column("ids"), dtype)[0], minlength=len(total))
                    c[: len(total)] += total
                    total = c
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "n"])

        counts = {r["id"]: r["n"] for r in ids.select("ids").mapInArrow(counted, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # a row for each id of the vocabulary at most
        bits = max(BITS, len(counts).bit_length() + 3)
        freqs = quantised(counts, bits) if counts else np.zeros(0, np.int64)
        table = [(int(i), int(freqs[i]), bits, width) for i in np.flatnonzero(freqs)]
        spark.createDataFrame(table, "id int, freq int, bits int, width int").coalesce(1).write.parquet(f"{folder}/frequencies")
        kind = ids.schema["key"].dataType
        names = ["file", "block", "first", "n", "lanes", "states", "marks", "words", "crc32", "keys", "lengths", "doc_nos", "piece_nos", "lasts"]
        schema = T.StructType([
            *(T.StructField(n, t) for n, t in zip(names, (T.IntegerType(), T.IntegerType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.BinaryType(), T.ArrayType(T.LongType()), T.BinaryType(), T.LongType()))),
            T.StructField("keys", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("doc_nos", T.ArrayType(T.LongType())), T.StructField("piece_nos", T.ArrayType(T.IntegerType())), T.StructField("lasts", T.ArrayType(T.BooleanType())),
        ])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, file, block, first, doc_no = Coder(freqs, bits), TaskContext.get().partitionId(), 0, 0, 0
            held, keys, lengths, piece = np.empty(0, dtype), None, np.empty(0, np.int64), 0  # what is still to be written; piece: the first one's number within its document

            def blocks(final: bool) -> Iterator[pa.RecordBatch]:
                nonlocal held, keys, lengths, piece, block, first, doc_no
                at = 0
                while len(held) - at >= block_size or final and at < len(held):
                    some = held[at : at + block_size]
                    ends = np.cumsum(lengths)
                    k = int(np.searchsorted(ends, len(some)))  # the document in which the block ends
                    parts = np.append(lengths[:k], len(some) - (ends[k - 1] if k else 0))
                    lasts = np.ones(k + 1, bool)
                    lasts[-1] = parts[-1] == lengths[k]
                    pieces = np.zeros(k + 1, np.int32)
                    pieces[0] = piece
                    lanes, states, marks, words = coder.encode(some)
                    row = [file, block, first, len(some), lanes, states.tobytes(), marks.tolist(), words.tobytes(), zlib.crc32(some.astype("<u4").tobytes())]
                    lists = [keys.slice(0, k + 1), pa.array(parts.astype(np.int64)), pa.array(np.arange(doc_no, doc_no + k + 1)), pa.array(pieces), pa.array(lasts)]
                    arrays = [pa.array([v], f.type) for v, f in zip(row, fields)] + [pa.ListArray.from_arrays(pa.array([0, k + 1], pa.int32()), x) for x in lists]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    at, block, first = at + len(some), block + 1, first + len(some)
                    gone = k + int(lasts[-1])
                    piece = 0 if lasts[-1] else int(pieces[-1]) + 1
                    doc_no, keys, lengths = doc_no + gone, keys.slice(gone), lengths[gone:].copy()
                    if len(lengths) and not lasts[-1]:
                        lengths[0] -= parts[-1]
                held = held[at:].copy()

            fields = [pa.field(n, t) for n, t in zip(names, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64()))]
            for b in batches:
                if not len(b):
                    continue
                new, n = _numbers(b.column("ids"), dtype)
                some = n > 0  # without an end id, empty texts have no piece
                held, lengths = np.concatenate([held, new]), np.concatenate([lengths, n[some]])
                k = b.column("key").filter(pa.array(some))
                keys = k if keys is None else pa.concat_arrays([keys, k])
                yield from blocks(False)
            yield from blocks(True)

        ordered = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "ids")
        ordered.drop("tie").mapInArrow(packed, schema).write.parquet(f"{folder}/blocks")


def pieces(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The pieces of documents that the blocks of a folder hold: (file, doc_no, piece_no, last, key, at, n, crc32), and ids on demand.

    Blocks are decoded in parallel, each held against its checksum. at: ids of the file before the piece. crc32: that of
    the piece's ids as little-endian numbers of 4 bytes.
    """
    table = spark.read.parquet(f"{folder}/frequencies").collect()  # a row for each id of the vocabulary at most
    blocks = spark.read.parquet(f"{folder}/blocks")
    freqs, bits = np.zeros(max((r["id"] for r in table), default=-1) + 1, np.int64), table[0]["bits"] if table else BITS
    for r in table:
        freqs[r["id"]] = r["freq"]
    names = ["file", "doc_no", "piece_no", "last", "key", "at", "n", "crc32"] + ["ids"] * with_ids
    kinds = [T.IntegerType(), T.LongType(), T.IntegerType(), T.BooleanType(), blocks.schema["keys"].dataType.elementType, T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.IntegerType())]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freqs, bits)
        for b in batches:
            for i in range(len(b)):
                of = {n: b.column(n)[i] for n in b.schema.names}
                lanes = of["lanes"].as_py()
                states = np.frombuffer(of["states"].as_buffer(), "<u8").reshape(-1, lanes)
                ids = coder.decode(of["n"].as_py(), states, of["marks"].values.to_numpy(), np.frombuffer(of["words"].as_buffer(), "<u4")).astype("<u4")
                if zlib.crc32(ids) != of["crc32"].as_py():
                    raise ValueError("a block of token ids is damaged: its checksum differs")
                n = of["lengths"].values.to_numpy()
                ends = np.cumsum(n)
                sums = [zlib.crc32(ids[lo:hi]) for lo, hi in zip(ends - n, ends)]
                arrays = [pa.array(np.full(len(n), of["file"].as_py(), np.int32)), of["doc_nos"].values, of["piece_nos"].values, of["lasts"].values, of["keys"].values, pa.array(of["first"].as_py() + ends - n), pa.array(n), pa.array(sums, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return blocks.mapInArrow(decoded, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document of a folder, by decoding all of it. start: ids of all documents before it."""
    found = materialise(pieces(spark, folder), "tokens-pieces")
    # a row for each file, of which a task wrote one: as many as partitions at most
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("file").agg(F.sum("n").alias("total"))
    before = sizes.select("file", F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    whole = found.where("last and piece_no = 0").select("file", "key", "at", "n", "crc32")
    split = found.where("not (last and piece_no = 0)").groupBy("file", "doc_no").agg(F.first("key").alias("key"), F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("piece_no", "crc32", "n"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [crc32_joined([(p["crc32"], 4 * p["n"]) for p in parts]) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("file", "key", "at", "n")), pa.array(sums, pa.int64())], ["file", "key", "at", "n", "crc32"])

    all_of = whole.unionByName(split.mapInArrow(joined, whole.schema))
    return all_of.join(F.broadcast(before), "file").select("key", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 2, by_chunks: bool = False, block_size: int = BLOCK) -> DataFrame:
    """(key, start, n_tokens, ids_crc32): writes the ids of docs to a folder that lasts as long as the call, and reads them back.

    A null text is empty, an empty one has the end id alone; a null key comes first; repeated rows each have their place;
    an empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    with scratch(spark):
        folder = scratch_folder(spark, "tokens")
        write(docs, folder, path, key, text, end, by_chunks, block_size)
        return materialise(read(spark, folder).withColumnRenamed("key", key), "tokens-read", keep=True)
