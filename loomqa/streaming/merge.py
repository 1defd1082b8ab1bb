"""Streaming extension: relation spans merged into a knowledge base as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from loomqa.operators.kb import merged_relations, read_records

SPAN_SCHEMA = "rel_id long, head string, type string, tail string, record string, url string, span_start int, span_end int, seen_at timestamp, ingested_at timestamp"
KEYS = ["head", "type", "tail", "url", "span_start", "span_end"]


def read_spans(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of relation spans from Parquet files, at most ``files`` a batch."""
    return spark.readStream.schema(SPAN_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def start_merge(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's distinct spans, of any age, to a table of spans, one folder a batch, so that a
    batch that is run again replaces what it wrote. :func:`merged` reads the base out of it and takes each
    span once, so copies in several batches need no state here."""

    def put(batch: DataFrame, batch_id: int) -> None:
        read_records(batch).select(*KEYS).distinct().write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, store: str) -> DataFrame:
    """The relations of all batches so far, with their spans by url."""
    return merged_relations(spark.read.parquet(store).select(*KEYS))


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Rows by kind and time window; a stream's late rows count within ``lateness``."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
