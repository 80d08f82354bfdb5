"""Streams give what the batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import feedback, metrics
from textloom.sources.feedback_log import FEEDBACK_SCHEMA
from textloom.streaming import live


def test_feedback_stream_equals_batch(spark, tmp_path):
    rows = [("q", str(i), i % 2, "t", "m1" if i % 3 else None, "r1" if i % 4 else None, "") for i in range(40)]
    log = spark.createDataFrame(rows, FEEDBACK_SCHEMA)
    log.write.json(str(tmp_path / "log"))
    seen = []
    stream = live.running_group_metrics(live.feedback_stream(spark, str(tmp_path / "log")))
    live.each_batch(stream, lambda df, n: seen.append(sorted(map(str, df.collect()))), str(tmp_path / "cp"), "complete")
    assert seen[-1] == sorted(map(str, feedback.group_metrics(log).collect()))


def test_rate_stream_equals_batch(spark, tmp_path):
    points = spark.range(600).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.lit(1.0).alias("value"))
    points.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "p"))
    live.run_once(live.rate_stream(stream, 300, 300, "kind"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("window_start", "kind", "increase").collect()}
    want = {tuple(r) for r in metrics.rate(points, 300, "kind").select("window_start", "kind", "increase").collect()}
    assert got and got <= want and len(want) - len(got) <= 2 * 3  # the last windows are still open


def test_ingest_stream_reads_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x" * 500)
    for expected in (2, 5):
        live.run_once(live.ingest_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (tmp_path / "in/b.txt").write_text("x" * 500 + "\f" + "y")


def test_ingest_stream_holds_a_file_at_a_time(spark, tmp_path):
    from tests.test_reference_operators import live_pages

    (tmp_path / "in").mkdir()
    for i in range(80):
        (tmp_path / f"in/{i}.txt").write_text("x")
    live.run_once(live.ingest_stream(spark, str(tmp_path / "in"), decoder=live_pages()), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 80 and max(int(r["chunk"]) for r in got) <= 2
