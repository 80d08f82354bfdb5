"""Registered queries that write to a store, or run a stream, and read back what
is there; each uses folders of its own in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import records
from textloom.session import scratch
from textloom.sources import feedback_log, pages
from textloom.streaming import live

from .catalog import register
from .standard import _FEEDBACK, _GROUPS, Spark, chunk_sql, docs, judged, read, window_sql

#: Pages in one written file, which a reader holds as a whole.
FILE_PAGES = 500

#: A document's page: its id, a colon and its text, with no form feed of its own.
_PAGE_SQL = "doc_id || ':' || replace(coalesce(text, ''), chr(12), ' ')"


def paged_files(spark: Spark, sf_dir: str) -> str:
    """All documents as pages of text files, each page ended by a form feed."""
    page = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" ")))
    out = scratch(spark, "pages")
    docs(spark, sf_dir).select(page.alias("value")).write.option("lineSep", "\f").option("maxRecordsPerFile", FILE_PAGES).text(out)
    return out


def _page_keys(found: DataFrame) -> DataFrame:
    """doc_id and digest of the pages; what follows a file's last form feed is empty."""
    return found.filter("page_text <> ''").select(F.substring_index("page_text", ":", 1).cast("long").alias("doc_id"), F.md5("page_text").alias("digest"))


@register("directory_scan", f"select doc_id, md5({_PAGE_SQL}) as digest from documents")
def directory_scan(spark: Spark, sf_dir: str) -> DataFrame:
    return _page_keys(pages.decode_pages(pages.scan_directory(spark, paged_files(spark, sf_dir), ".txt")))


@register("pages_source", f"select doc_id, md5({_PAGE_SQL}) as digest from documents")
def pages_source(spark: Spark, sf_dir: str) -> DataFrame:
    spark.dataSource.register(pages.PagesSource)
    return _page_keys(spark.read.format("pages").option("suffix", ".txt").load(paged_files(spark, sf_dir)))


@register("document_texts", f"select sum(length({_PAGE_SQL}) + 1)::bigint as chars from documents")
def document_texts(spark: Spark, sf_dir: str) -> DataFrame:
    """Whole texts: each page and its line end, the empty page after a file's last one taken off."""
    found = pages.decode_pages(pages.scan_directory(spark, paged_files(spark, sf_dir), ".txt"))
    whole = pages.document_texts(found.filter("page_text <> ''"))
    return whole.agg(F.sum(F.length("text")).cast("long").alias("chars"))


@register("index_upsert", "select doc_id::varchar as id, case when lang = 'en' then 'new ' else 'old ' end || md5(coalesce(text, '')) as chunk_text, 'docs' as index_name from documents")
def index_upsert(spark: Spark, sf_dir: str) -> DataFrame:
    """Every document is written, then those of one language again with another text."""
    out = scratch(spark, "index")

    def made(word: str) -> DataFrame:
        text = F.concat(F.lit(f"{word} "), F.md5(F.coalesce("text", F.lit(""))))
        return docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), text.alias("chunk_text"), "lang")

    records.write_index(made("old").drop("lang"), out, "docs")
    records.write_index(made("new").filter("lang = 'en'").drop("lang"), out, "docs")
    return spark.read.parquet(out).select("id", "chunk_text", "index_name")


@register("feedback_append", f"select chunk_id, feedback, dense_model, rerank_model, true as stamped from {_FEEDBACK} f union all select chunk_id, feedback, dense_model, rerank_model, true from {_FEEDBACK} f")
def feedback_append(spark: Spark, sf_dir: str) -> DataFrame:
    """The judgements, appended to a log twice and read strictly."""
    out = scratch(spark, "feedback")
    rows = judged(spark, sf_dir).select("chunk_id", "feedback", "dense_model", "rerank_model")
    feedback_log.append_feedback(rows, out)
    feedback_log.append_feedback(rows, out)
    back = feedback_log.read_feedback(spark, out)
    return back.select("chunk_id", "feedback", "dense_model", "rerank_model", F.try_to_timestamp("timestamp").isNotNull().alias("stamped"))


@register("feedback_stream", f"select dense_model, rerank_model, round(precision, 9) as precision, hit_rate, n from {_GROUPS} g")
def feedback_stream(spark: Spark, sf_dir: str) -> DataFrame:
    log, out = scratch(spark, "feedback"), scratch(spark, "stream")
    feedback_log.append_feedback(judged(spark, sf_dir).select("chunk_id", "feedback", "dense_model", "rerank_model"), log)
    running = live.running_group_metrics(live.feedback_stream(spark, log))
    live.each_batch(running, lambda rows, _: rows.write.mode("overwrite").parquet(out), scratch(spark, "offsets"), "complete")
    return spark.read.parquet(out).withColumn("precision", F.round("precision", 9))


@register("rate_stream", f"select window_start, event_type, increase, per_second from ({window_sql('event_type')}) w where window_start + interval '6 minutes' <= (select max(ts) from events)")
def rate_stream(spark: Spark, sf_dir: str) -> DataFrame:
    """Windows that have ended, with a minute's grace, when the stream has seen all rows."""
    batch = read(spark, sf_dir, "events")
    rows = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{{events}}.parquet")  # a pattern may also be one file
    stream = rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(1.0).alias("value"))
    out = scratch(spark, "stream")
    live.run_once(live.rate_stream(stream, 300, 300, "event_type"), out, scratch(spark, "offsets"))
    return spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "increase", F.round("per_second", 9).alias("per_second"))


@register("ingest_stream", f"select paragraph_index, md5(chunk) as chunk from ({chunk_sql(500, 80).replace('from documents', 'from (select doc_id, ' + _PAGE_SQL + ' as text from documents) d')}) c")
def ingest_stream(spark: Spark, sf_dir: str) -> DataFrame:
    """Chunks of the files that a stream finds in a folder."""
    out = scratch(spark, "stream")
    live.run_once(live.ingest_stream(spark, paged_files(spark, sf_dir)), out, scratch(spark, "offsets"))
    return spark.read.parquet(out).select("paragraph_index", F.md5("chunk").alias("chunk"))
