"""Keeping chunks and vectors current as books arrive, and windows over timed events (extras; the batch operators are the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.models import embedded
from lectern.operators.chunkers import chunked


def chunk_new_books(spark: SparkSession, source: str, target: str, checkpoint: str, method: str, params: dict[str, object]) -> None:
    """Chunk and embed the files that have come since the last run; each is done once, whatever fails in between.

    A batch is written under its own number and replaced when it is tried again.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        books = batch.select(F.col("doc_id").alias("source_file"), "text")
        embedded(chunked(books, method, params), "text").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums of events by tumbling window and type; works on streams and on tables."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
