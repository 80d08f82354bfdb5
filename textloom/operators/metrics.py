"""Operational metrics: counters, ratios, histograms and quantiles by time."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# Bucket edges in seconds, and the instruments by kind.
EDGES = (0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)
COUNTERS = (
    "documents_ingested_total",
    "ingestion_errors_total",
    "chunk_count_total",
    "chunk_chars_sum",
    "pdf_pages_total",
    "text_extraction_failures_total",
    "queries_total",
    "query_errors_total",
    "retrieval_result_count",
    "upsert_records_total",
    "upsert_errors_total",
    "retrieval_any_result_total",
    "no_result_queries_total",
)
HISTOGRAMS = (
    "document_ingest_seconds",
    "pdf_load_seconds",
    "metadata_extract_seconds",
    "chunking_seconds",
    "query_end_to_end_seconds",
    "vector_search_seconds",
    "upsert_batch_seconds",
    "retrieval_top_score",
)

#: Trailing ranges in a stretch of time that one task reads.
STRETCH = 64

POINT_SCHEMA = "ts timestamp, name string, kind string, value double, attrs map<string,string>"


def rate(points: DataFrame, seconds: int, *by: str, slide: int | None = None) -> DataFrame:
    """Increase per second of a counter in each window; per minute as well."""
    span = F.window("ts", f"{seconds} seconds", f"{slide or seconds} seconds")
    grouped = points.groupBy(span.alias("w"), *by).agg(F.sum("value").alias("increase"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "increase", (F.col("increase") / seconds).alias("per_second"), (F.col("increase") * 60 / seconds).alias("per_minute"))


def trailing_rate(points: DataFrame, seconds: int, *by: str) -> DataFrame:
    """At each point, the increase per second of the trailing range.

    Points are dealt out by stretches of time, so a label's points do not meet
    in one task; the last ``seconds`` of a stretch are lent to the next one.
    """
    long = STRETCH * seconds
    at = F.col("ts").cast("timestamp").cast("long")
    rows = points.select(F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("row"), F.struct(F.lit(0).alias("all"), *by).alias("key"), "value", at.alias("at"))
    own = F.floor(F.col("at") / long)
    lent = F.when(F.pmod("at", F.lit(long)) >= long - seconds, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(lent))
    w = Window.partitionBy("key", "part").orderBy("at").rangeBetween(-seconds + 1, 0)
    return rows.withColumn("per_second", F.sum("value").over(w) / seconds).filter("part = own").select("row.*", "at", "per_second")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def histogram(points: DataFrame, *by: str, value: str = "value", edges: tuple[float, ...] = EDGES) -> DataFrame:
    """by, le, cum: cumulative counts at each edge and at infinity, in one pass."""
    counts = [F.sum((F.col(value) <= e).cast("long")).alias(f"c{i}") for i, e in enumerate(edges)]
    wide = points.filter(F.col(value).isNotNull()).groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("all"))
    if not by:
        wide = wide.filter(F.col("all") > 0)
    rows = F.array(*(F.struct(F.lit(float(e)).alias("le"), F.col(f"c{i}").alias("cum")) for i, e in enumerate(edges)), F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("cum")))
    return wide.select(*by, F.inline(rows))


def quantile(buckets: DataFrame, phi: float, *by: str) -> DataFrame:
    """by, quantile: linear within the first bucket that reaches phi; the last
    finite edge where that is the open one."""
    return quantiles(buckets, [phi], *by).drop("phi")


def quantiles(buckets: DataFrame, phis: list[float], *by: str) -> DataFrame:
    """by, phi, quantile, from one pass over the buckets."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("le")
    edge = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("cum").over(w), F.lit(0))).withColumn("total", F.max("cum").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    want = F.col("phi") * F.col("total")
    one = edge.withColumn("phi", F.explode(F.array(*map(F.lit, phis)))).filter((F.col("cum") >= want) & (F.col("before") < want))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (want - F.col("before")) / (F.col("cum") - F.col("before"))
    return one.select(*by, "phi", F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def query_outcomes(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, n_results, any_result, top_score; queries without hits stay."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("score").try_cast("double")).alias("top_score"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_results"), F.col("n").isNotNull().alias("any_result"), "top_score")


@contextmanager
def timed(points: list[tuple], name: str, **attrs: str) -> Iterator[None]:
    """Append a duration point; a failure is marked and raised again."""
    began = time.perf_counter()
    try:
        yield
    except BaseException:
        attrs["status"] = "error"
        raise
    finally:
        points.append((name, "histogram", time.perf_counter() - began, attrs))


def observed(df: DataFrame, name: str, *exprs: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters that its next action fills."""
    seen = Observation(name)
    return df.observe(seen, *exprs), seen


def export_points(spark: SparkSession, points: list[tuple], path: str) -> None:
    """Append driver-side points (name, kind, value, attrs) to the metric table."""
    rows = [(name, kind, float(value), {k: str(v) for k, v in attrs.items()}) for name, kind, value, attrs in points]
    df = spark.createDataFrame(rows, "name string, kind string, value double, attrs map<string,string>")
    df.select(F.current_timestamp().alias("ts"), "*").write.mode("append").parquet(path)


def write_metrics(metrics: DataFrame, run_id: str, path: str) -> None:
    """Append (run_id, key, value) rows of an evaluation."""
    metrics.select(F.lit(run_id).alias("run_id"), "key", "value").write.mode("append").parquet(path)
