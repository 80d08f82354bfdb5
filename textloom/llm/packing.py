"""Concatenate-and-cut packing.

Every document's ids and one separator are laid end to end and cut into
windows of a fixed length.  First pass: tokenise each scan segment, keep each
document's offset in its segment and stage the ids.  The segments' totals (one
row a segment, as many as there are input splits) are summed up in order into
segment offsets.  Second pass: each document is cut at the window borders that
its global offsets cross; each piece is one boundary record.  Texts are never
shuffled.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, stage

SEPARATOR = 1
#: What both tokenizer libraries split alike for certain: printable Latin text
#: and plain blanks.  Other texts, special strings and very long words go to
#: the reference library.
_UNSURE = re.compile("[^\t\n\r -~¡-ſ]")
_LONG = re.compile(r"\S{400}")

_loaded: dict[tuple, object] = {}


class ByteIds:
    """Ids of a byte-level vocabulary, as its library gives them."""

    def __init__(self, json_path: str, ranks_path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def sure(self, text: str) -> bool:
        return not (_UNSURE.search(text) or _LONG.search(text) or any(s in text for s in self.special))

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and self.sure(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def ids_for(json_path: str, ranks_path: str | None) -> ByteIds:
    key = (json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = ByteIds(json_path, ranks_path)
    return _loaded[key]


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the place in the files read, where the input is files."""
    base = [F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")]
    try:
        place = docs.metadataColumn("_metadata")  # not a column of that name
        return docs.select(*base, place["file_path"].alias("file"), place["row_index"].alias("row"))
    except AnalysisException:
        return docs.select(*base, F.lit("").alias("file"), F.lit(None).cast("long").alias("row"))


def tokenised(docs: DataFrame, json_path: str, ranks_path: str | None, id_col: str, text_col: str) -> DataFrame:
    """First pass, staged: segment (file, start), id, offset in the segment,
    number of ids with the separator, and the ids as little-endian 32 bits,
    packed to 16 bits where all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_for(json_path, ranks_path).ids
        part = TaskContext.get().partitionId()
        file = start = None
        at = seen = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                files, rows = some.column(2).to_pylist(), some.column(3).to_pylist()
                out = {"file": [], "start": [], "at": [], "n": [], "ids": []}
                for text, f, r in zip(some.column(1).to_pylist(), files, rows):
                    if f != file:
                        # without files, segments follow the partitions' numbers
                        file, start, at = f, (part << 33) if r is None else r, 0
                    ids = np.array([*encode(text), SEPARATOR], dtype="<u4")
                    out["file"].append(file)
                    out["start"].append(start)
                    out["at"].append(at)
                    out["n"].append(len(ids))
                    out["ids"].append((ids.astype("<u2") if ids.max() < 65536 else ids).tobytes())
                    at += len(ids)
                    seen += 1
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(out["file"], pa.string()), pa.array(out["start"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.binary())],
                    ["id", "file", "start", "at", "n", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = _ordered(docs, id_col, text_col).mapInArrow(run, f"id {kind}, file string, start long, at long, n long, ids binary")
    return stage(out, "pack-ids", "zstd")


def cut(n: int, begin: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of n ids from ``begin`` on."""
    out, at = [], 0
    while at < n:
        seq, off = divmod(begin + at, window)
        size = min(n - at, window - off)
        out.append((at, size, seq, off))
        at += size
    return out


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow each other as they lie in the files read (file name, then
    row), or else by partition and row.  All sequences but the last are full,
    so padding is below one window in all.  A null text is empty and has the
    separator only; null ids stay; repeated rows are packed each; an empty
    table gives no rows; extra columns are not read, whatever their names.
    """
    ids = tokenised(docs, json_path, ranks_path, id_col, text_col)
    totals = ids.groupBy("file", "start").agg(F.sum("n").alias("total"))  # one row a scan segment
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(totals.select("file", "start", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "pack-offsets")
    offsets = narrow(offsets, 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, crcs, totals_, seqs, offs = [], [], [], [], [], [], []
            for k, (at, n, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                all_ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4", copy=False)
                for s, size, seq, off in cut(n, at, window):
                    rows.append(k)
                    starts.append(s)
                    sizes.append(size)
                    crcs.append(zlib.crc32(all_ids[s : s + size]))
                    totals_.append(n)
                    seqs.append(seq)
                    offs.append(off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals_, seqs, offs))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ids.join(offsets, ["file", "start"]).select("id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")
    out = placed.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
