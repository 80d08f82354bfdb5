"""Dense, sparse and hybrid top-k retrieval over batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.metadata import unprefixed
from textloom.functions.text import terms, trim_ws
from textloom.operators.embedding import Reader, embed, given, readable
from textloom.session import small_batches

#: How many times k the dense channel fetches, and the default k.
OVERFETCH, DEFAULT_K = 4, 5
#: Queries up to this number are sent to the tasks.
MOST_BROADCAST = 4096
#: Parameters of the term weighting.
K1, B = 1.2, 0.75
#: Records and queries that meet in one matrix product.
DOCS_AT_ONCE, QUERIES_AT_ONCE = 256, 256
#: Term shares of records that are held at a time.
MOST_SHARES = 1 << 20
#: Packs of rows in a part that meets more queries than are sent to the tasks.
PACKS_A_PART = 16


def top_k(scored: DataFrame, k: int, query: str = "query_id", key: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; ties to the smaller id."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _rounded(x: np.ndarray) -> np.ndarray:
    y = np.abs(x)
    y *= 1e6
    y += 0.5
    np.floor(y, out=y)
    y /= 1e6
    y *= np.sign(x)
    return y


class _Best:
    """The k best rows of each query among those met so far; ties to the
    smaller id.  Holds some k rows a query, however many were met."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.most = max(1 << 15, 2 * queries * k)  # rows held before the worst go
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.n = 0

    def add(self, score: np.ndarray, ids: pa.Array, first: int = 0) -> None:
        """Scores of the queries from number ``first`` on, a row each, with the
        rows of ``ids``; of -inf is no hit, NaN is above all."""
        top = np.nan_to_num(score, nan=np.inf, posinf=np.inf, neginf=-np.inf) if np.isnan(score).any() else score
        least = self.least[first : first + len(score)]
        good = (top >= least[:, None]) & (top > -np.inf)
        rows, n = score.shape[1], np.count_nonzero(good)
        if n > 2 * self.k * len(score) and rows > self.k:
            good &= top >= np.partition(top, rows - self.k, axis=1)[:, rows - self.k, None]
            n = np.count_nonzero(good)
        if n:
            q, at = np.nonzero(good)
            self.held.append((q + first, score[q, at], ids.take(pa.array(at))))
            self.n += n
            if self.n > self.most:
                self._drop()

    def _drop(self) -> None:
        q, score = (np.concatenate([h[c] for h in self.held]) for c in (0, 1))
        ids = pa.concat_arrays([h[2] for h in self.held])
        place = np.empty(len(ids), dtype=np.int64)
        place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -score, ~np.isnan(score), q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = order[rank == self.k - 1]
        self.least[q[rank == self.k - 1]] = np.where(np.isnan(score[last]), np.inf, score[last])
        kept = order[rank < self.k]
        self.held, self.n = [(q[rank < self.k], score[kept], ids.take(pa.array(kept)))], len(kept)

    def batches(self, q_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """What is held, as query_id, id and score."""
        if self.held:
            self._drop()
            q, score, ids = self.held[0]
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), ids, pa.array(score)], ["query_id", "id", "score"])


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K * OVERFETCH, block: int = 4096, query_block: int = 256) -> DataFrame:
    """query_id, rank, id, score: exact inner products of (query_id, vector)
    with (id, vector).

    The stated query set meets every row, a block of rows with a block of
    queries at a time as one matrix product.  Up to ``MOST_BROADCAST`` queries
    are sent to the tasks, each of which gives k rows for a query; more meet
    the rows pack by pack, and k rows for a query leave each part of the rows.
    Null vectors take no part.
    """
    vector = F.col("vector").cast("array<double>")
    return _dense(queries.select("query_id", vector.alias("vector")), corpus.select("id", vector.alias("value")), lambda: given, k, block, query_block)


def _dense(queries: DataFrame, rows: DataFrame, reader: Callable[[], Reader], k: int, block: int = 4096, query_block: int = 256) -> DataFrame:
    """``dense_topk`` of (query_id, vector) with (id, value), whose vectors
    ``reader`` reads where the rows are read."""
    small_batches(rows.sparkSession)
    kinds = [queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    queries = queries.filter("vector is not null")

    def read(batches: Iterator[pa.RecordBatch], reader: Callable[[], Reader], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Ids and vectors of ``size`` rows at most."""
        vectors = reader()
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                at, x = vectors(part.column(1))
                if len(at):
                    yield part.column(0).take(pa.array(at)), x

    def meet(best: _Best, ids: pa.Array, x: np.ndarray, q: np.ndarray) -> None:
        for low in range(0, len(q), query_block):
            best.add(_rounded(q[low : low + query_block] @ x.T), ids, low)

    if queries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        asked = queries.toArrow().combine_chunks()  # a bounded number
        if not asked.num_rows:
            return top_k(rows.sparkSession.createDataFrame([], schema), k).select("query_id", "rank", "id", "score")
        q_ids, q = asked.column(0).chunk(0), given(asked.column(1).chunk(0))[1]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(q), k)
            for ids, x in read(batches, reader, block):
                meet(best, ids, x, q)
            yield from best.batches(q_ids)

        return top_k(rows.mapInArrow(scan, schema), k).select("query_id", "rank", "id", "score")

    def packed(some: DataFrame, reader: Callable[[], Reader], size: int, names: list[str], kind: str) -> DataFrame:
        """Up to ``size`` ids and their vectors, end to end, a row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = [], []

            def row() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([_listed(pa.concat_arrays(ids)), _listed(pa.array(np.concatenate(x).ravel()))], names)
                ids.clear()
                x.clear()
                return out

            for some_ids, some_x in read(batches, reader, size):
                if ids and sum(map(len, ids)) + len(some_ids) > size:
                    yield row()
                ids.append(some_ids)
                x.append(some_x)
            if ids:
                yield row()

        return some.mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} array<double>")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                asked, q, ids, x = (batch.column(c)[i].values for c in range(4))
                if q_ids is None or not asked.equals(q_ids):  # the rows of a part follow each other for each pack of queries
                    if q_ids is not None:
                        yield from best.batches(q_ids)
                    q_ids, best = pa.concat_arrays([asked]), _Best(len(asked), k)
                meet(best, ids, x.to_numpy().reshape(len(ids), -1), q.to_numpy().reshape(len(asked), -1))
        if q_ids is not None:
            yield from best.batches(q_ids)

    # shuffled, so that packs are made once and not for each part that they meet
    cores = rows.sparkSession.sparkContext.defaultParallelism
    asked = packed(queries, lambda: given, 4 * query_block, ["q_ids", "q"], kinds[0]).repartition(max(1, cores // 4))
    parts = max(cores, -(-rows.count() // (PACKS_A_PART * block)))
    met = asked.hint("shuffle_replicate_nl").join(packed(rows, reader, block, ["ids", "x"], kinds[1]).repartition(parts), how="cross")
    return top_k(met.select("q_ids", "q", "ids", "x").mapInArrow(pairs, schema), k).select("query_id", "rank", "id", "score")


def _listed(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def query_terms(queries: DataFrame, text_col: str = "q") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(text_col))).alias("term"))


def sparse_topk(queries: DataFrame, records: DataFrame, k: int = DEFAULT_K, id_col: str = "id", text_col: str = "chunk_text", where: Column | None = None) -> DataFrame:
    """query_id, rank, id, score: BM25 of (query_id, q) over the records.

    Two scans.  The first counts in how many records each query term is; the
    second scores each record against all queries where it is read, so only k
    rows a query leave a batch.  ``where`` restricts the records.  Up to
    ``MOST_BROADCAST`` queries go by their terms' weights, sent to the tasks;
    more go as joins by term.
    """
    rows = records if where is None else records.filter(where)
    wanted = query_terms(queries)
    words = rows.select(F.col(id_col).alias("id"), terms(text_col).alias("w")).filter(F.size("w") > 0)
    vocabulary = wanted.select("term").distinct()
    few = queries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    size = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))  # one row
    flat = words.select("id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).join(vocabulary, "term", "left_semi")
    if not few:
        tf = flat.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weighted = wanted.join(df, "term").join(F.broadcast(size)).select("query_id", "term", "avgdl", _idf().alias("idf"))
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = tf.join(weighted, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
        return top_k(scored, k).select("query_id", "rank", "id", "score")

    once = words.select(F.explode(F.array_distinct("w")).alias("term")).join(vocabulary, "term", "left_semi")
    df = once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = wanted.join(F.broadcast(df), "term").join(F.broadcast(size)).select("query_id", "term", "avgdl", _idf().alias("idf")).collect()  # the terms of a bounded number of queries
    spark = records.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(), records.schema[id_col].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not weights:
        return top_k(spark.createDataFrame([], schema), k).select("query_id", "rank", "id", "score")
    names = sorted({r["query_id"] for r in weights}, key=str)
    number = {q: i for i, q in enumerate(names)}
    column = {t: i for i, t in enumerate(sorted({r["term"] for r in weights}))}
    entries = np.array([(number[r["query_id"]], column[r["term"]], r["idf"]) for r in weights])
    entries = entries[np.argsort(entries[:, 0], kind="stable")]
    avgdl, q_type = weights[0]["avgdl"], queries.select("query_id").limit(0).toArrow().schema.field(0).type
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, listed = _Best(len(names), k), pa.array(list(column), pa.string())
        docs_at_once = max(1, min(DOCS_AT_ONCE, MOST_SHARES // len(column)))

        @lru_cache(1)
        def piece(low: int) -> tuple[np.ndarray, np.ndarray]:
            """The terms of the queries from number ``low`` on, by those queries."""
            some = entries[slice(*np.searchsorted(entries[:, 0], [low, low + QUERIES_AT_ONCE]))]
            own, at = np.unique(some[:, 1].astype(int), return_inverse=True)
            out = np.zeros((len(own), min(QUERIES_AT_ONCE, len(names) - low)))
            out[at, some[:, 0].astype(int) - low] = some[:, 2]
            return own, out

        for batch in batches:
            for low in range(0, batch.num_rows, docs_at_once):
                part = batch.slice(low, docs_at_once)
                size = pc.list_value_length(part.column(1)).to_numpy()
                at = pc.fill_null(pc.index_in(part.column(1).flatten(), listed), -1).to_numpy()
                cell = (np.repeat(np.arange(len(size)) * len(column), size) + at)[at >= 0]
                tf = np.bincount(cell, minlength=len(size) * len(column)).reshape(len(size), -1)
                share = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * size / avgdl))[:, None])
                for q in range(0, len(names), QUERIES_AT_ONCE):
                    own, weight = piece(q)
                    score = (share[:, own] @ weight).T
                    # every term of a query that a record has counts for it
                    best.add(np.where(score == 0, -np.inf, _rounded(score)), part.column(0), q)
        yield from best.batches(pa.array(names, q_type))

    return top_k(words.select("id", "w").mapInArrow(run, schema), k).select("query_id", "rank", "id", "score")


def _idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def embedded_topk(queries: DataFrame, records: DataFrame, k: int, id_col: str = "id", text_col: str = "chunk_text", model: str | None = None) -> DataFrame:
    """Dense channel over texts: both sides embedded by the named model where
    they are read, then ``dense_topk``."""
    value, reader = readable(F.col(text_col), model)
    asked = queries.select("query_id", embed(F.col("q"), model).alias("vector"))
    return _dense(asked, records.select(F.col(id_col).alias("id"), value.alias("value")), reader, k)


def hybrid_search(queries: DataFrame, records: DataFrame, k: int = DEFAULT_K, id_col: str = "id", text_col: str = "chunk_text", model: str | None = None) -> DataFrame:
    """query_id, channel, channel_ord, rank, id, score: 4k dense hits, then k
    sparse ones; neither merged nor fused.  Blank queries give no rows."""
    asked = queries.filter(trim_ws(F.coalesce("q", F.lit(""))) != "")
    k = max(k, 1)
    dense = embedded_topk(asked, records, OVERFETCH * k, id_col, text_col, model).select("query_id", F.lit("dense").alias("channel"), F.lit(0).alias("channel_ord"), "rank", "id", "score")
    sparse = sparse_topk(asked, records, k, id_col, text_col).select("query_id", F.lit("sparse").alias("channel"), F.lit(1).alias("channel_ord"), "rank", "id", "score")
    return dense.unionByName(sparse)


def normalize_hits(hits: DataFrame) -> DataFrame:
    """id, score, text, metadata, page_number, paragraph_index, source_file,
    title from raw hits (_id, _score, fields: map of texts)."""
    f = F.col("fields")

    def at(name: str) -> Column:
        return F.try_element_at(f, F.lit(name))

    meta = unprefixed(f)
    text = F.coalesce(F.nullif(at("chunk_text"), F.lit("")), F.nullif(at("text"), F.lit("")), F.lit(""))
    place = [F.coalesce(at(c), at(f"meta_{c}")) for c in ("page_number", "paragraph_index", "source_file")]
    number = [p.try_cast("double").cast("int") for p in place[:2]]
    return hits.select(F.col("_id").alias("id"), F.col("_score").cast("double").alias("score"), text.alias("text"), meta.alias("metadata"), number[0].alias("page_number"), number[1].alias("paragraph_index"), place[2].alias("source_file"), at("meta_title").alias("title"))


def query_params(raw: DataFrame) -> DataFrame:
    """query_id, q, k, dense_model, reranker_model with the defaults filled in."""
    from textloom.sources.catalogs import DEFAULT_DENSE, DEFAULT_RERANKER

    k = F.greatest(F.coalesce(trim_ws("k").try_cast("int"), F.lit(DEFAULT_K)), F.lit(1))
    named = [F.coalesce(F.nullif(trim_ws(c), F.lit("")), F.lit(d)).alias(c) for c, d in (("dense_model", DEFAULT_DENSE), ("reranker_model", DEFAULT_RERANKER))]
    return raw.select("query_id", trim_ws(F.coalesce("q", F.lit(""))).alias("q"), k.alias("k"), *named).filter("q <> ''")
