"""Structured Streaming forms: feedback evaluation, rates, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import feedback as fb
from textloom.operators.chunking import chunk_pages
from textloom.sources.feedback_log import FEEDBACK_SCHEMA
from textloom.sources.pages import Decoder, decode_pages, form_feed_decoder


def feedback_stream(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK_SCHEMA).json(directory)


def running_group_metrics(feedback: DataFrame) -> DataFrame:
    """``group_metrics`` over a stream, for complete or update output: the
    state is one row for each pair of models."""
    return fb.group_metrics(feedback)


def rate_stream(points: DataFrame, seconds: int, slide: int, *by: str, late: str = "1 minute") -> DataFrame:
    """Increase per second in sliding windows; rows later than ``late`` are
    dropped, and a window is given once it has ended for certain."""
    span = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    grouped = points.withWatermark("ts", late).groupBy(span.alias("w"), *by).agg(F.sum("value").alias("increase"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "increase", (F.col("increase") / seconds).alias("per_second"))


def ingest_stream(spark: SparkSession, directory: str, suffix: str = ".txt", decoder: Decoder = form_feed_decoder) -> DataFrame:
    """Chunks of files as they arrive; each file is read once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").load(directory)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")
    return chunk_pages(decode_pages(named, decoder))


def run_once(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """All that is there now, to an append sink; waits until it is done."""
    query = stream.writeStream.format(fmt).outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(action).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
