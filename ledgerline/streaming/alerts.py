"""Streams: critical events become alerts once, rows are taken in once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_alerts(events: DataFrame, title: Column, critical: Column, time: str = "ts", delay: str = "30 days") -> DataFrame:
    """The first critical event of each normalised title (case and outer blanks off) within the delay; state older than the
    delay is dropped."""
    told = events.filter(critical).withColumn("title", F.lower(F.trim(title)))
    return told.withWatermark(time, delay).dropDuplicatesWithinWatermark(["title"])


def critical_events(events: DataFrame, least: float = 90.0, delay: str = "30 days") -> DataFrame:
    """Errors over a value, by the event type and a group of users."""
    title = F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string"))
    return first_alerts(events, title, (F.col("event_type") == "error") & (F.col("value") > least), delay=delay)


def ingest(stream: DataFrame, path: str, checkpoint: str, key: list[str], partition: str | None = None) -> StreamingQuery:
    """Appends rows whose key is not stored yet; a batch that is tried again writes nothing twice.

    Of the store only the key columns are read, and with `partition` (a column that a key never changes) only the
    partitions that the batch has rows in.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        try:
            stored = spark.read.parquet(path)
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        else:
            if partition:
                own = [r[0] for r in batch.select(partition).distinct().toLocalIterator()]
                stored = stored.filter(F.col(partition).isin(own))
            fresh = fresh.join(stored.select(*key), key, "left_anti")
        writer = fresh.write.mode("append")
        (writer.partitionBy(partition) if partition else writer).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
