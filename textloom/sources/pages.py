"""Paged documents: directory scans, a data source for pages, whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.session import small_batches

#: Decodes a file's bytes to (page texts, document information).
Decoder = Callable[[bytes], tuple[list[str | None], dict[str, str]]]

PAGE_SCHEMA = "source_file string, page_number int, page_text string, info map<string,string>, status string, error_type string"

#: Characters and pages that leave a file's decoder at a time.
BATCH_CHARS, BATCH_PAGES = 1 << 20, 1000


def form_feed_decoder(content: bytes) -> tuple[list[str | None], dict[str, str]]:
    """Plain text with form feeds between pages; the stand-in for a PDF parser."""
    return list(content.decode("utf-8").split("\f")), {}


def pdf_decoder(content: bytes) -> tuple[list[str | None], dict[str, str]]:
    """PDF pages, where a PDF library is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    reader = PdfReader(io.BytesIO(content))
    return [page.extract_text() for page in reader.pages], {str(k): str(v) for k, v in (reader.metadata or {}).items()}


def scan_directory(spark: SparkSession, directory: str, suffix: str = ".pdf") -> DataFrame:
    """Files of one directory by case-sensitive suffix: path, source_file, length, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "length", "content")


def decode_pages(files: DataFrame, decoder: Decoder = form_feed_decoder) -> DataFrame:
    """One row per page, numbered from 1, null text as "".

    A file that cannot be decoded gives one row with its error and no page, so
    it stops no other file.  A worker holds one file's pages, and a batch of
    the files' bytes.
    """

    small_batches(files.sparkSession)

    def rows(name: str, content: bytes | None) -> list[tuple]:
        try:
            pages, info = decoder(bytes(content))
            return [(name, n, text or "", dict(info), "success", None) for n, text in enumerate(pages, 1)]
        except Exception as e:  # noqa: BLE001  any decoder fault becomes a row
            return [(name, None, None, None, "error", type(e).__name__)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                some, chars = [], 0
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    some.append(row)
                    chars += len(row[2] or "")
                    if chars >= BATCH_CHARS or len(some) >= BATCH_PAGES:
                        yield _page_batch(some)
                        some, chars = [], 0
                if some:
                    yield _page_batch(some)

    return files.select("source_file", "content").mapInArrow(run, PAGE_SCHEMA)


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = {"source_file": text, "page_number": pa.int32(), "page_text": text, "info": pa.map_(text, text), "status": text, "error_type": text}
    return pa.RecordBatch.from_arrays([pa.array([list(r[c].items()) if isinstance(r[c], dict) else r[c] for r in rows], kind) for c, kind in enumerate(kinds.values())], list(kinds))


def document_texts(pages: DataFrame) -> DataFrame:
    """source_file and its whole text, each page followed by a line end."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("page_text", F.lit("")).alias("t"))))
    text = F.concat(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n"), F.lit("\n"))
    return pages.groupBy("source_file").agg(text.alias("text"))


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".txt")

    def store(self):  # noqa: ANN201
        """The file system of the folder, and the folder's path in it."""
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, root = self.store()
        found = fs.get_file_info(pafs.FileSelector(root))
        return [_FilePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(self.suffix)] or [_FilePartition("")]

    def read(self, partition: _FilePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with self.store()[0].open_input_stream(partition.path) as f:
            content = f.read()
        name = partition.path.rsplit("/", 1)[-1]
        decoder = pdf_decoder if self.suffix == ".pdf" else form_feed_decoder
        try:
            pages, info = decoder(content)
        except Exception as e:  # noqa: BLE001
            yield (name, None, None, None, "error", type(e).__name__)
            return
        for n, text in enumerate(pages, 1):
            yield (name, n, text or "", dict(info), "success", None)


class PagesSource(DataSource):
    """``spark.read.format("pages").option("suffix", ".txt").load(directory)``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PagesReader(self.options)


def ensure_index(spark: SparkSession, name: str, path: str, schema: str) -> DataFrame:
    """The index table of that name, made empty if it is missing."""
    table, place = "`" + name.replace("`", "``") + "`", path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet LOCATION '{place}'")
    return spark.table(table)
