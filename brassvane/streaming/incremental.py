"""Incremental forms of batch operators: new rows appended once, windowed counts with late data, duplicates dropped in flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's unseen keys go into the published table at `path`; a batch that runs twice adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        files.append_new(batch, path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, total) per window; in a stream, rows later than `late` are left out and windows close behind it."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    w = F.window("_t", window)
    return e.withWatermark("_t", late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def first_seen(events: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within `late`; state older than that is dropped."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(key).drop("_t")
