"""Saving in batches that survive being stopped: a stream's offsets, batches that may run twice, and a record of each commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, COMMITS = "rows", "commits"


def save(
    spark: SparkSession, source: str, schema: T.StructType | str, target: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    files_per_batch: int = 10, source_format: str = "parquet", before_commit: Callable[[int], None] | None = None,
) -> None:
    """Takes what is new in the folder source, works on it batch by batch, and saves each batch's rows to target.

    Offsets (files of a batch) are written to target's checkpoint before a batch runs, and once it has run. A batch's rows
    replace whatever a stopped run left in the batch's own folder, then a record of the commit is written; saved() reads
    only recorded batches. So a run that is killed anywhere and started again leaves the rows of one that wasn't, and each row
    is worked on again only if its batch wasn't committed. before_commit is called between rows and record.
    """

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/{ROWS}/batch={number}")
        if before_commit is not None:
            before_commit(number)
        n = spark.read.parquet(f"{target}/{ROWS}/batch={number}").count()
        record = spark.range(1).select(F.lit(n).cast("bigint").alias("n_rows"))
        record.write.mode("overwrite").json(f"{target}/{COMMITS}/batch={number}")

    stream = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", files_per_batch).load(source)
    running = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()


def commits(spark: SparkSession, target: str) -> DataFrame:
    """(batch, n_rows) of each batch that was saved whole; none before the first."""
    shape = "n_rows bigint, batch bigint"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{COMMITS}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "batch bigint, n_rows bigint")
    # the folder's name tells the batch as well; of a record that a killed task left half-written there is no row
    return spark.read.schema(shape).json(f"{target}/{COMMITS}").where("n_rows is not null").select("batch", "n_rows")


def saved(spark: SparkSession, target: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches that were saved whole, of the given schema, with their batch."""
    of = spark.createDataFrame([], schema).schema
    whole = T.StructType([*of.fields, T.StructField("batch", T.LongType())])
    if commits(spark, target).isEmpty():
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(f"{target}/{ROWS}")
    return rows.join(commits(spark, target).select("batch"), "batch", "left_semi").select(*of.names, "batch")


def remaining(everything: DataFrame, spark: SparkSession, target: str, schema: T.StructType | str, key: str) -> DataFrame:
    """The rows of everything whose key no committed batch has: what a run that is started again has to do. Null keys remain."""
    return everything.join(saved(spark, target, schema).select(key).distinct(), key, "left_anti")
