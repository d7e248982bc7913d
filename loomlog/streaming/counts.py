"""Counts over a growing table with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.storage import scratch_path


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """Events by type and hour.  The stream takes what is there, keeps its offsets, and would go on from them.

    Counts of a micro-batch are written as they are and summed when read, so that nothing waits for a watermark."""
    base = scratch_path(spark, "counts")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{base}/out/batch={number}")  # a repeated batch replaces itself

    query = source.select("event_type", "ts").writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("event_type string, hour timestamp, n bigint").parquet(f"{base}/out")
    return rows.groupBy("event_type", "hour").agg(F.sum("n").alias("n"))
