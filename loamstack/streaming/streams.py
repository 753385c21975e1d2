"""Structured Streaming: documents ingested as files arrive, and windowed log statistics with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking


def stream_table(spark: SparkSession, path: str, like: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of parquet files as a stream, with the schema of the files at ``like``."""
    return spark.readStream.schema(spark.read.parquet(like).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Good documents as parent and child chunks; each batch is overwritten under its own number, so a repeated batch doubles nothing."""

    def write(batch: DataFrame, number: int) -> None:
        parents = chunking.parents(chunking.good_documents(batch))
        parents.write.mode("overwrite").parquet(f"{out}/parents/batch={number}")
        chunking.children(parents).write.mode("overwrite").parquet(f"{out}/children/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_stats(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean value by window and type; rows later than ``late`` are dropped in a stream."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_within(events: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten after ``ttl``."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)
