"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about equal size.  With a weight of a/H, its
k-th block is released at floor(k H / a) and due by ceil((k + 1) H / a); taking
the released block with the earliest deadline in each slot keeps every source
within one block of its share at all times.  Weights are rounded to whole
numbers over a period H, so the schedule repeats and one period of it, a table
of H entries, gives the slot of any block by arithmetic: no step runs through
the blocks.  When a source ends, a new phase begins in which the others share
its weight; no document is left out or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, shuffle_width, stage

#: Sources are carried as their name behind a mark, a null one as this.
NO_SOURCE = "-"


def source_key(name: str | None) -> str:
    return NO_SOURCE if name is None else "=" + name


def quanta(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers of at least 1 that add up to ``period``, by largest remainder."""
    if len(weights) > period:
        raise ValueError("the period must be at least the number of sources")
    total = sum(Fraction(w) for w in weights.values())
    if total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    free = period - len(weights)
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    spare = {s: max(x - 1, Fraction(0)) for s, x in exact.items()}
    whole = sum(spare.values())
    share = {s: x * free / whole if whole else Fraction(free, len(weights)) for s, x in spare.items()}
    out = {s: 1 + int(x) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def one_period(parts: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in a period: earliest deadline first."""
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(t)
        if k + 1 < parts[s]:
            heapq.heappush(waiting, ((k + 1) * period // parts[s], s, k + 1))
    return slots


def plan(weights: dict[str, float], blocks: dict[str, int], period: int) -> list[dict]:
    """Rows of (source, phase, first and next block, quanta, start, slots)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    for phase in range(len(left)):
        live = {s: weights.get(s, 0.0) for s in left}
        if not any(live.values()):  # sources of no weight come last, evenly
            live = dict.fromkeys(left, 1.0)
        else:
            live = {s: w for s, w in live.items() if w > 0}
        parts = quanta(live, period)
        slots = one_period(parts)

        def slot(s: str, k: int) -> int:
            return k // parts[s] * period + slots[s][k % parts[s]]  # noqa: B023

        length = min(slot(s, left[s] - 1) for s in live) + 1
        full, rest = divmod(length, period)
        for s in live:
            used = full * parts[s] + int(np.searchsorted(slots[s], rest))
            if used:
                out.append({"source": s, "phase": phase, "first": done[s], "next": done[s] + used, "quanta": parts[s], "start": start, "slots": slots[s]})
            done[s] += used
            left[s] -= used
        left = {s: n for s, n in left.items() if n}
        start += length
        if not left:
            break
    return out


def positions(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Staged: source (its key), id, hash, size, and the bytes before it in its
    source.

    Documents are in the order of a hash of id, source and text, so rows that
    repeat an id or have none lie apart.  They are dealt out by ranges of
    (source, hash), so a source that holds most rows is spread over many
    tasks; each task keeps running sums, and the tasks' totals (a row for each
    task and source in it) are summed up into offsets.
    """
    spark = docs.sparkSession
    name = F.col(source_col).cast("string")
    key = F.when(name.isNull(), F.lit(NO_SOURCE)).otherwise(F.concat(F.lit("="), name))
    sized = docs.select(key.alias("source"), F.col(id_col).alias("id"), row_hash(id_col, source_col, text_col).alias("hash"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"))
    sized = stage(sized, "mix-sizes")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            before = []
            for source, size in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if source != now:
                    now, total = source, 0
                before.append(total)
                total += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array([part] * len(before), pa.int32())], ["source", "id", "hash", "size", "before", "part"])

    dealt = sized.repartitionByRange(shuffle_width(spark), "source", "hash", "id").sortWithinPartitions("source", "hash", "id", "size")
    local = stage(dealt.mapInArrow(run, f"source string, id {kind}, hash long, size long, before long, part int"), "mix-sums")
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("source", "part").agg(F.sum("size").alias("total"))
    offsets = stage(totals.select("source", "part", F.coalesce(F.sum("total").over(so_far), F.lit(0)).alias("base")), "mix-offsets")
    return local.join(narrow(offsets, 100_000), ["source", "part"]).select("source", "id", "hash", "size", (F.col("base") + F.col("before")).alias("before"))


def row_hash(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(source_col).cast("string"), F.col(text_col), F.lit(1))


def _slots(docs: DataFrame, weights: dict[str | None, float] | None, power: float, block_bytes: int, period: int, id_col: str, source_col: str, text_col: str) -> DataFrame | None:
    """The schedule with the rows' hashes and sources' keys; None without rows."""
    spark = docs.sparkSession
    placed = positions(docs, id_col, source_col, text_col).withColumn("block", F.floor(F.col("before") / block_bytes))
    sources = placed.groupBy("source").agg(F.sum("size").alias("bytes")).collect()  # a row a source
    if not sources:
        return None
    blocks = {r["source"]: -(-r["bytes"] // block_bytes) for r in sources}
    share = {source_key(s): w for s, w in weights.items()} if weights is not None else {r["source"]: float(r["bytes"]) ** power for r in sources}
    period = max(period, 2 * len(blocks))
    rows = [(p["source"], p["phase"], p["first"], p["next"], p["quanta"], p["start"], p["slots"]) for p in plan(share, blocks, period)]
    # a row for each source and phase, at most `period` slots in a phase
    table = spark.createDataFrame(rows, "to string, phase int, first long, next long, quanta int, start long, slots array<int>")
    table = F.broadcast(table) if len(rows) * period <= 10_000_000 else table
    hit = placed.join(table, (F.col("source") == F.col("to")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("next")))
    k = F.col("block") - F.col("first")
    due = F.col("start") + F.expr(f"((block - first + 1) * {period} + quanta - 1) div quanta")
    slot = F.col("start") + F.expr(f"((block - first) div quanta) * {period}") + F.get("slots", F.pmod(k, F.col("quanta")).cast("int"))
    release = F.col("start") + F.expr(f"((block - first) * {period}) div quanta")
    return hit.select("id", "hash", "source", "size", "before", "block", "phase", release.alias("release"), due.alias("deadline"), slot.alias("slot"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block_bytes: int = 1 << 18, period: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The schedule: id, source, size, before, block, phase, release, deadline, slot.

    ``weights`` are target shares of the bytes by source (unnamed sources come
    after the named ones have ended); without them a source's share is its
    size to the ``power``.  A document's block is that in which its first byte
    lies, so a longer document uses up the blocks it runs over.  Reading by
    (slot, before) gives the mix.

    A null source is a source of its own, apart from any name; a null text has
    one byte (its end, which every document has); null ids and repeated rows
    stay, each in its own place; an empty table gives none; extra columns are
    not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = _slots(docs, weights, power, block_bytes, period, id_col, source_col, text_col)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, source string, size long, before long, block long, phase int, release long, deadline long, slot long")
    name = F.when(F.col("source") != NO_SOURCE, F.substring("source", 2, 1 << 30))
    return found.select(F.col("id").alias(id_col), name.alias("source"), "size", "before", "block", "phase", "release", "deadline", "slot")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block_bytes: int = 1 << 18, period: int = 1000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` in the order of the mix: its partitions, one after another,
    hold the rows by slot.

    All rows and columns stay, whatever the columns' names.  Nulls, empty
    texts and empty tables are as in ``mix``; rows with the same id, source and
    text lie in the place of the first of them.  The places (a few numbers a
    row) are broadcast while they are few, so the texts are shuffled once.
    """
    found = _slots(docs, weights, power, block_bytes, period, id_col, source_col, text_col)
    if found is None:
        return docs
    places = stage(found.groupBy("hash").agg(F.min(F.struct("slot", "before")).alias("at")).select("hash", "at.slot", "at.before"), "mix-places")
    rows = docs.select(row_hash(id_col, source_col, text_col).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = ["slot", "before"]
    joined = rows.join(narrow(places), "hash", "left").select("row", *at)
    return joined.repartitionByRange(shuffle_width(docs.sparkSession), *at).sortWithinPartitions(*at).select("row.*")
