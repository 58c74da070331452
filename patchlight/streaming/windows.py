"""Counts of events in windows of time, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.sources import files


def counted(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by type and window; what comes later than the watermark is left out of a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the table of events has now, through a stream that ends with it.

    Each batch writes the windows that it changed as Parquet to the shared folder, under its number; read back, the last
    batch's row of a window counts. So nothing is held on the driver, and a batch that runs again replaces its own files.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at, out = files.fresh_folder(spark, "stream-state"), files.fresh_folder(spark, "stream-windows")
    result = counted(events).select(F.col("w.start").alias("start"), "event_type", "n", "value")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/part={number}")

    result.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n bigint, value double, batch bigint, part bigint").parquet(out)
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("r"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "r.n", F.round("r.value", 4).alias("value"))
