"""Streams: the reference's idempotent re-runs, keyed overlay and spend ledger as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def feed(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_deliveries(rows: DataFrame, key: str, event_time: str, late: str = "30 days") -> DataFrame:
    """Each key once, within the watermark: rows delivered again are dropped, late ones up to ``late`` are taken."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def spend_by_window(spend: DataFrame, event_time: str, cost: str, width: str = "1 hour", late: str = "1 hour", *by: str) -> DataFrame:
    """Cost per time window, out once the watermark has passed it."""
    return spend.withWatermark(event_time, late).groupBy(F.window(event_time, width), *by).agg(F.count("*").alias("n"), F.sum(cost).alias("cost"))


def overlay(rows: DataFrame, folder: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each key in ``folder``: every batch is laid over the state before it and written as a new version,
    so a batch that is run again after a failure gives the same state."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        now = df
        if n > 0:
            before = spark.read.parquet(f"{folder}/v{n - 1}")
            now = store.upsert(before, df.select(*before.columns), keys, *order)
        else:
            now = store.latest(df, keys, *order)
        now.write.mode("overwrite").parquet(f"{folder}/v{n}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
