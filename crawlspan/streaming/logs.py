"""Log lines as a stream: parsed, counted by window with a watermark, and written in micro-batches.

An extension beyond the batch operators: windows over event time with late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder (or one file) as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, *keys, events): counts by tumbling window; what comes later than `late` is dropped, which bounds the state."""
    if dict(events.dtypes)[time] == "timestamp_ntz":
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("_w"), *keys).agg(F.count("*").alias("events")).select(F.col("_w.start").alias("window_start"), *keys, "events")


def sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = "2 seconds", mode: str = "append"):
    """Writes a stream to Parquet in micro-batches; `every` of None takes what is there and ends. A batch is written once: its
    folder carries its number, so that a batch repeated after a failure replaces itself. With mode `update` a window is written again
    whenever it changes; `latest` gives its last state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of what `sink` wrote with mode `update`."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
