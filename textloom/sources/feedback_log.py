"""The feedback log: JSON lines, read strictly or leniently, and appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK_SCHEMA = "query string, chunk_id string, feedback int, chunk_text string, dense_model string, rerank_model string, timestamp string"


def read_feedback(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Strict: a broken or blank line fails the query.  Else a broken line
    becomes a row with the line in ``_corrupt``."""
    if strict:
        line = F.col("value")
        full = F.when(F.trim(line) == "", F.raise_error(F.lit("blank line in the feedback log"))).otherwise(line)
        parsed = F.from_json(full, FEEDBACK_SCHEMA, {"mode": "FAILFAST"})
        return spark.read.text(path).select(parsed.alias("f")).select("f.*")
    return spark.read.schema(FEEDBACK_SCHEMA + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def stamped(feedback: DataFrame) -> DataFrame:
    """The rows with the time of receipt in UTC, whatever the client sent."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return feedback.withColumn("timestamp", now)


def append_feedback(feedback: DataFrame, path: str) -> None:
    stamped(feedback).write.mode("append").json(path)
