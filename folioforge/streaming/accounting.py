"""Streams of token records and events: windowed totals, repeated records, the newest records of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.traces import newest


def _watched(frame: DataFrame, at: str, late: str) -> DataFrame:
    """The frame with a watermark; times without zone are taken as they stand, in the session's zone."""
    return frame.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def _plain(time):
    return time.cast("timestamp_ntz")


def token_windows(records: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", record_id: str = "record_id") -> DataFrame:
    """Calls and tokens of each category and window; works on batches and streams.

    Repeated records within the lateness count once; rows later than that are dropped by a stream, never by a batch.
    """
    watched = _watched(records, at, late)
    once = watched.dropDuplicatesWithinWatermark([record_id]) if records.isStreaming else records.dropDuplicates([record_id])
    grouped = once.groupBy(F.window(at, width), F.coalesce("category", F.lit("__none__")).alias("category"))
    sums = grouped.agg(F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return sums.select(_plain(F.col("window.start")).alias("window_start"), "category", "calls", "input_tokens", "output_tokens")


def resource_windows(samples: DataFrame, at: str, value: str, by: str, width: str = "1 minute", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Mean and peak of samples in tumbling or sliding windows."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    grouped = _watched(samples, at, late).groupBy(window, by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.max(value).alias("peak_value"))
    return grouped.select(_plain(F.col("window.start")).alias("window_start"), by, "n", "mean_value", "peak_value")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each group: neighbouring events no further apart than the gap."""
    grouped = _watched(events, at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
    return grouped.select(_plain(F.col("session_window.start")).alias("session_start"), _plain(F.col("session_window.end")).alias("session_end"), by, "n")


def keep_newest(stream: DataFrame, folder: str, by: str, at: str, key: str, n: int, checkpoint: str):
    """A ring buffer on disk: after each micro-batch the n newest records of each group, in a folder of that batch's number.

    Only the n newest of the last folder and of the batch are read, and the stream's checkpoint makes a batch repeatable.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch
        if number > 0:
            held = held.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/b{number - 1}"))
        newest(held.dropDuplicates([key]), by, at, key, n).drop("place").write.mode("overwrite").parquet(f"{folder}/b{number}")
        # The last folder stays, so that this batch can be repeated; the one before it isn't read any more.
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/b{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
