"""Stage-log monitor as a stream. An extension: the mirrored library has no streaming surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_peaks(log: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Peak and mean by stage and event-time window of a log (ts, event_type, value); works on streams too."""
    timed = log.withWatermark("ts", late) if log.isStreaming else log
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.max("value").alias("peak"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "peak", "mean", "n")


def follow(spark: SparkSession, path: str, schema: str, checkpoint: str, table: str, **window):
    """Keep a table of stage peaks as log files arrive in a folder."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stage_peaks(stream, **window).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)
