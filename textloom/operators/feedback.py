"""Evaluation of models by feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_metrics(feedback: DataFrame) -> DataFrame:
    """dense_model, rerank_model, precision, hit_rate, n; a missing dense model
    is "unknown"; a missing reranker and the name "none" are two groups."""
    hit = F.max(F.when(F.col("feedback") != 0, 1.0).otherwise(0.0))
    return feedback.groupBy(F.coalesce("dense_model", F.lit("unknown")).alias("dense_model"), "rerank_model").agg(F.coalesce(F.avg("feedback"), F.lit(0.0)).alias("precision"), hit.alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def metric_tags(metrics: DataFrame, k: int = 5) -> DataFrame:
    """key, value: two named metrics for each group."""
    tag = F.concat_ws("_", "dense_model", F.coalesce(F.nullif("rerank_model", F.lit("")), F.lit("none")))
    pairs = F.array(F.struct(F.concat(F.lit(f"precision_at_{k}_"), tag).alias("key"), F.col("precision").alias("value")), F.struct(F.concat(F.lit(f"hit_rate_at_{k}_"), tag).alias("key"), F.col("hit_rate").alias("value")))
    return metrics.select(F.inline(pairs))


def no_reranker(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("", "none")


def macro_average(metrics: DataFrame, by: str) -> DataFrame:
    """Mean precision of the groups: of dense models without a reranker, or of
    rerankers over the dense models."""
    rows = metrics.filter(no_reranker(F.col("rerank_model")) if by == "dense_model" else ~no_reranker(F.col("rerank_model")))
    return rows.groupBy(by).agg(F.avg("precision").alias("avg_precision"))


def best_model(feedback: DataFrame, by: str, position: str) -> DataFrame:
    """The model with the best macro average; of equal ones that seen first in
    the log.  No rows where that kind of model is missing."""
    own = feedback.withColumn("dense_model", F.coalesce("dense_model", F.lit("unknown")))
    plain = no_reranker(F.col("rerank_model"))
    seen = own.filter(plain if by == "dense_model" else ~plain).groupBy(by).agg(F.min(position).alias("first_seen"))
    ranked = macro_average(group_metrics(feedback), by).join(seen, by)
    return ranked.orderBy(F.desc("avg_precision"), "first_seen").limit(1).select(F.lit(by).alias("family"), F.col(by).alias("model"), "avg_precision")


def precision_at_k(hits: DataFrame, feedback: DataFrame, k: int = 5) -> DataFrame:
    """query_id, precision: share of each query's first k hits that were marked good."""
    good = feedback.groupBy(F.col("chunk_id").alias("id")).agg(F.max("feedback").alias("good"))
    top = hits.filter(F.col("rank") <= k).join(good, "id", "left")
    return top.groupBy("query_id").agg((F.sum(F.coalesce("good", F.lit(0))) / F.lit(k)).alias("precision"))
