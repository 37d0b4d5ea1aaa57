"""Verdict events as a stream: the newest one per key. An extension; batch reads do the same with ``latest``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest_by_key(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Running newest row of each key by event time, for update or complete mode; rows later than ``late`` are dropped by the watermark."""
    rest = [c for c in events.columns if c not in keys]
    newest = events.withWatermark(time, late).groupBy(*keys).agg(F.max(F.struct(time, *[c for c in rest if c != time])).alias("n"))
    return newest.select(*keys, "n.*")


def once_per_key(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark: a resumed run's repeats go."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of what a stateful stream holds: each batch writes it whole, so a batch that runs again changes nothing."""
    write = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
