"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its number of initial symbols less its number of merges, so
no identifiers are made.  Blanks become the word mark and one mark is put
before the text; no vocabulary piece holds a mark behind another character
(checked when the vocabulary is read), so a text falls into units (a run of
marks and the characters up to the next mark) that never merge with each
other.  Units repeat, so their counts are kept in a bounded cache per worker.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
#: Units up to this long are cached, and this many of them at most.
CACHE_CHARS, CACHE_UNITS = 48, 600_000

_loaded: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens of a piece vocabulary with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        self.free_units = True
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            self.rank[piece] = -model.get_score(i)
            if MARK in piece.lstrip(MARK) or ("\n" in piece and piece != "\n"):
                self.free_units = False
        self.cache: dict[str, int] = {}

    def merges(self, unit: str) -> int:
        """How many merges happen: pop the best-ranked adjacent pair, leftmost
        first among equals, link the list past it, push the two new pairs."""
        rank, size = self.rank.get, len(unit)
        heap = []
        for i in range(size - 1):
            r = rank(unit[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        if not heap:
            return 0
        heapq.heapify(heap)
        # end[i]: where the symbol that starts at i ends, 0 once it is merged away.
        end = list(range(1, size + 1))
        before = list(range(-1, size))
        done = 0
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= size or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            done += 1
            if stop < size:
                before[stop] = i
                after = end[stop]
                r = rank(unit[i:after])
                if r is not None:
                    heapq.heappush(heap, (r, i, after))
            left = before[i]
            if left >= 0:
                r = rank(unit[left:stop])
                if r is not None:
                    heapq.heappush(heap, (r, left, stop))
        return done

    def unit(self, unit: str) -> int:
        rank = self.rank
        symbols = 0
        for c in unit:
            symbols += 1 if c in rank else len(c.encode("utf-8", "surrogatepass"))
        return symbols - self.merges(unit)

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.free_units:
            return self.unit(marked)
        cache, total = self.cache, 0
        for unit, times in Counter(_UNIT.findall(marked)).items():
            n = cache.get(unit)
            if n is None:
                n = self.unit(unit)
                if len(unit) <= CACHE_CHARS:
                    if len(cache) >= CACHE_UNITS:
                        cache.clear()
                    cache[unit] = n
            total += n * times
        return total


def counter_for(model_path: str) -> PieceCounter:
    """One counter per worker process and vocabulary."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceCounter(model_path)
    return _loaded[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    A narrow map: no shuffle, memory bounded by a batch and the cache.  A null
    text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
    rows give repeated rows; an empty table gives none; other columns are not
    read.  Whole texts are counted, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_for(model_path).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = pa.array([count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = read.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
