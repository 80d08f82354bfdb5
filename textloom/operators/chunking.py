"""Fixed-size chunks with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk size and overlap of the ingest, and of the plain helper.
INGEST_SIZE, INGEST_OVERLAP = 500, 80
HELPER_SIZE, HELPER_OVERLAP = 1000, 100


def chunk_array(text: Column, size: int = HELPER_SIZE, overlap: int = HELPER_OVERLAP) -> Column:
    """Windows of ``size`` characters from every ``size - overlap``-th on."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda at: F.substring(text, at + 1, F.lit(size))))


def chunk_pages(pages: DataFrame, text_col: str = "page_text", size: int = INGEST_SIZE, overlap: int = INGEST_OVERLAP) -> DataFrame:
    """One row per chunk: the page's other columns, paragraph_index, chunk.

    Null and empty pages give no chunks.  The document's metadata and
    provenance are carried along, so no join is needed.
    """
    rest = [c for c in pages.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return pages.select(*rest, F.posexplode(chunk_array(text, size, overlap)).alias("paragraph_index", "chunk"))


def chunk_stats(pages: DataFrame, key: str, text_col: str = "page_text") -> DataFrame:
    """Chunks and their characters per key; keys without chunks count 0."""
    chunks = chunk_array(F.coalesce(F.col(text_col), F.lit("")), INGEST_SIZE, INGEST_OVERLAP)
    sized = pages.select(key, F.coalesce(chunks, F.array().cast("array<string>")).alias("c"))
    each = sized.select(key, F.size("c").cast("long").alias("n"), F.coalesce(F.length(F.concat_ws("", "c")), F.lit(0)).cast("long").alias("chars"))
    return each.groupBy(key).agg(F.sum("n").alias("chunk_count"), F.sum("chars").alias("chunk_chars"))
