"""Large CSV files whose fields span lines, read in splits: no task reads a whole file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORD = "file string, begins bigint, first boolean, record string"


def _cutter(parts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of lines in order, with whether their split begins within quotes and is its file's first: the records that begin and end in a split, or else the parts of those that don't."""
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string()] + [pa.bool_()] * parts
    names = ["file", "begins", "first", "record"] + ["opens"] * parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, first, entered, held = None, False, False, False, []  # entered: the open record, whose lines are held, began in an earlier split
        done: list[tuple] = []

        def part(lines: list[str], opens: bool) -> None:
            if parts:
                done.append((*at, first and opens, "\n".join(lines), opens))

        for b in batches:
            if not len(b):
                continue
            odd = pc.bit_wise_and(pc.count_substring(b.column("value"), '"'), 1).to_numpy(zero_copy_only=False)
            file, begins, value = b.column("file").dictionary_encode().indices.to_numpy(), b.column("begins").to_numpy(), b.column("value")
            starts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (begins[1:] != begins[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], len(b)]):
                split = b.column("file")[lo].as_py(), int(begins[lo])
                if split != at:
                    if held:
                        part(held, not entered)
                    at, inside, first, held = split, b.column("inside")[lo].as_py(), b.column("leads")[lo].as_py(), []
                    entered = inside
                within = np.cumsum(odd[lo:hi]) % 2 ^ int(inside)  # after each line
                ends = np.flatnonzero(within == 0) + lo + 1
                if len(ends):
                    head = held + value[lo : ends[0]].to_pylist()
                    if entered:
                        part(head, False)
                    elif not parts:
                        done.append((*at, first, "\n".join(head)))
                    if not parts:
                        lines = value[ends[0] : ends[-1]].to_pylist()
                        done.extend((*at, False, "\n".join(lines[x - ends[0] : y - ends[0]])) for x, y in zip(ends, ends[1:]))
                    first, entered, held = False, False, []
                held += value[ends[-1] if len(ends) else lo : hi].to_pylist()
                inside = bool(within[-1])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                done.clear()
        if held:
            part(held, not entered)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    return cut


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, begins, first, record): the records of CSV files as texts, with the split that they begin in; first: the first of its file.

    Quotes stand only around fields and, doubled, within quoted ones. So a line's end is a record's end if the quotes before
    it are even. First the quotes of each split are counted, which tells for both states that it may begin in how it ends;
    running sums over a file's splits then fix the states (a row for each split, sent to all tasks). Then records are cut in
    parallel. Of those that span splits each split gives its part, in a further pass over the lines, and the parts are
    joined. Line feeds end lines; a carriage return before a record's end goes with it. A file that ends within quotes ends
    its last record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begins"))
    quotes = lines.groupBy("file", "begins").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    of_file = Window.partitionBy("file").orderBy("begins")
    before = F.coalesce(F.sum("odd").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    states = quotes.select("file", "begins", (before % 2 == 1).alias("inside"), (F.row_number().over(of_file) == 1).alias("leads"))
    # as many rows as splits, of spark.sql.files.maxPartitionBytes each; a join by broadcast keeps the lines of a split in order
    known = lines.join(F.broadcast(states), ["file", "begins"]).select("file", "begins", "inside", "leads", "value")
    whole = known.mapInArrow(_cutter(False), _RECORD)
    parts = known.mapInArrow(_cutter(True), _RECORD + ", opens boolean")
    # one record of a file at most is open between two splits: a part belongs to the last one that was opened before
    opened = Window.partitionBy("file").orderBy("begins", "opens").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("of", F.last(F.when(F.col("opens"), F.col("begins")), ignorenulls=True).over(opened))
    pieces = F.array_sort(F.collect_list(F.struct("begins", "record")))
    joined = parts.groupBy("file", F.col("of").alias("begins")).agg(F.bool_or("first").alias("first"), F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """The rows of CSV files (the first record of each is its header, unless not header): the columns of schema by position.

    Empty fields, and those that don't fit their column's type, are null; records without a character are no rows.
    """
    found = records(spark, path).where("record <> ''")
    if header:
        found = found.where("not first")
    shape = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return found.select(F.from_csv("record", shape, {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": "", "mode": "PERMISSIVE"}).alias("r")).select("r.*")
