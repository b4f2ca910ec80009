"""Incremental runs over a growing folder: new cards join the bucket counts, late ones within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def card_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Crash cards of a folder as a stream of new Parquet files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def first_deliveries(cards: DataFrame, time: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """Cards not delivered before: one per ``card_id`` within the watermark, which bounds the state kept."""
    return cards.withWatermark(time, delay).dropDuplicatesWithinWatermark(["card_id"])


def windowed_counts(cards: DataFrame, time: str = "ingested_at", width: str = "1 day", delay: str | None = "30 days") -> DataFrame:
    """Cards per bug and time window; a window is final once the watermark has passed it. ``delay`` is None for a stream that has a watermark."""
    marked = cards.withWatermark(time, delay) if delay else cards
    return marked.groupBy(F.window(time, width).alias("w"), "big_bucket").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "big_bucket", "n")


def maintain_buckets(cards: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch's cards per bucket to ``table`` under the batch's number; a repeated batch replaces itself.

    Buckets are read back with :func:`current_buckets`. Only counts are written, so the table grows with buckets and
    batches, not with cards.
    """
    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_case"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return cards.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_buckets(spark: SparkSession, table: str) -> DataFrame:
    """Buckets over all batches so far."""
    return spark.read.parquet(table).groupBy("cluster_key").agg(F.sum("n").alias("size"), F.min("first_case").alias("first_case"))
