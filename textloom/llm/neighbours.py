"""Nearest neighbours with randomly rotated one-bit codes.

Index: every vector, less the mean of all, is rotated by one seeded random
orthogonal matrix; its code is the sign of each coordinate, packed into bits,
with two scalars: its length and the inner product of the unit residual with
its own code.  Query: the rotated query is cut into bit planes, so an inner
product with a code is a few popcounts; divided by the code's scalar it is an
unbiased estimate, with an error bound that holds with high probability.  The
vectors whose bound reaches the k-th best exact distance are reranked on the
original components, the rest is skipped.

The index lies in blocks of rows, the queries in blocks too; each pair of
blocks is one row of work, in bounded memory, and gives at most k rows for a
query.  All blocks meet all queries, so with a fixed share of rows as queries
the popcounts grow with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SEED = 20240229
#: Bit planes of a quantised query.
PLANES = 8
#: Standard deviations of the estimate's error that the bound allows for.
EPSILON = 3.0


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes as 64-bit words, residual lengths, inner products with the codes)."""
    dim = x.shape[1]
    rest = (x - mean) @ turn
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(length > 0, length, 1)[:, None]
    bits = np.packbits(unit > 0, axis=1)
    words = -(-dim // 64)
    codes = np.zeros((len(x), words * 8), dtype=np.uint8)
    codes[:, : bits.shape[1]] = bits
    own = np.abs(unit).sum(axis=1) / np.sqrt(dim)
    return codes.view(np.uint64), length, np.where(length > 0, own, 1.0)


class Query:
    """One rotated query as bit planes with its correction scalars."""

    def __init__(self, planes: np.ndarray, low: float, step: float, total: int, length: float, dim: int):
        self.planes, self.low, self.step, self.total, self.length, self.dim = planes, low, step, total, length, dim

    @classmethod
    def of(cls, q: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> Query:
        dim = len(q)
        rest = (q - mean) @ turn
        length = float(np.linalg.norm(rest))
        unit = rest / (length or 1.0)
        low = float(unit.min())
        step = float(unit.max() - low) / (2**PLANES - 1) or 1.0
        level = np.rint((unit - low) / step).astype(np.uint16)
        planes = np.zeros((PLANES, -(-dim // 64) * 8), dtype=np.uint8)
        for j in range(PLANES):
            bits = np.packbits((level >> j) & 1)
            planes[j, : len(bits)] = bits
        return cls(planes.view(np.uint64), low, step, int(level.sum()), length, dim)

    def bounds(self, codes: np.ndarray, ones: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated, least likely) squared distances to the coded vectors."""
        dot = np.zeros(len(codes), dtype=np.int64)
        for j in range(PLANES):
            dot += np.bitwise_count(codes & self.planes[j]).sum(axis=1, dtype=np.int64) << j
        root = np.sqrt(self.dim)
        raw = (2 * self.step * dot + 2 * self.low * ones - self.step * self.total - self.dim * self.low) / root
        estimate = raw / own
        slack = EPSILON * np.sqrt(np.maximum(1 - own**2, 0)) / (own * np.sqrt(max(self.dim - 1, 1))) + root * self.step / 2 / own
        base = length**2 + self.length**2
        reach = 2 * length * self.length
        return base - reach * estimate, base - reach * (estimate + slack)


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to ``q``, each summed coordinate by coordinate."""
    return np.sqrt(np.ascontiguousarray(((x - q) ** 2).T).sum(axis=0))


def top(q: np.ndarray, query: Query, own_no: int, k: int, nos: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, ones: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and exact distances of the k nearest in a block, and how many were reranked."""
    estimate, least = query.bounds(codes, ones, length, own)
    allowed = nos != own_no
    estimate = np.where(allowed, estimate, np.inf)
    probe = np.argpartition(estimate, k)[:k] if len(ids) > k else np.arange(len(ids))
    probe = probe[allowed[probe]]
    if not len(probe):
        return ids[:0], np.zeros(0), 0
    reach = distance(x[probe], q).max() if len(probe) >= k else np.inf
    # a little room for rounding, so that equal distances are not lost
    pick = np.flatnonzero(allowed & (least <= reach * reach * (1 + 1e-9) + 1e-12))
    pick = np.union1d(pick, probe)
    exact = distance(x[pick], q)
    order = np.lexsort((ids[pick], exact))[:k]
    return ids[pick][order], exact[order], len(pick)


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles): no null, zero or non-finite vectors, no null ids."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def search(rows: DataFrame, every: int = 100, k: int = 10, block: int = 4096, query_block: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but the query's own.  Nearest first, ties to the smaller id.  Vectors
    that are null, zero or hold null or non-finite components take no part,
    nor do null ids, nor vectors of another than the most common length.  Rows
    that repeat an id are candidates each, and queries each: every such row
    has its own k rows, and the others among its candidates.  A table without valid vectors
    gives no rows.  Extra columns are not read.
    """
    spark = rows.sparkSession
    usable = valid(rows, id_col, vec_col)
    sizes = usable.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("queries")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not sizes or not sizes[0]["queries"]:
        return spark.createDataFrame([], out_schema)
    dim, n_queries = sizes[0]["dim"], sizes[0]["queries"]
    usable = usable.filter(F.size("vec") == dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total += _matrix(batch.column(1), dim).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())], ["at", "total", "n"])

    centre = usable.mapInArrow(sums, "at int, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("at").collect()  # one row a dimension
    mean, turn = np.array([r["mean"] for r in centre]), rotation(dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                x = _matrix(some.column(1), dim)
                codes, length, own = encode(x, mean, turn)
                ids = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                nos = np.arange(part + n, part + n + len(ids))
                n += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (nos, ids, x, codes, length, own)], ["nos", "ids", "x", "codes", "length", "own"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries among the rows of the index."""
        for batch in batches:
            for nos, ids, x in zip(*(batch.column(c).to_pylist() for c in range(3))):
                nos, ids = np.frombuffer(nos, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                at = np.flatnonzero(ids % every == 0)
                vectors = np.frombuffer(x).reshape(-1, dim)[at]
                yield pa.RecordBatch.from_arrays([pa.array(nos[at]), pa.array(ids[at]), pa.array([v.tobytes() for v in vectors], pa.binary())], ["no", "id", "q"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries, each rotated and cut into bit planes once."""
        for batch in batches:
            for at in range(0, batch.num_rows, query_block):
                some = batch.slice(at, query_block)
                nos, ids = (some.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                q = np.frombuffer(b"".join(some.column(2).to_pylist())).reshape(-1, dim)
                found = [Query.of(v, mean, turn) for v in q]
                planes = np.array([f.planes for f in found])
                scalars = np.array([(f.low, f.step, f.total, f.length) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (nos, ids, q, planes, scalars)], ["q_nos", "q_ids", "q", "planes", "scalars"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                nos, ids, q_nos, q_ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("nos", "ids", "q_nos", "q_ids"))
                x, q = (np.frombuffer(row[c]).reshape(-1, dim) for c in ("x", "q"))
                codes = np.frombuffer(row["codes"], dtype=np.uint64).reshape(len(ids), -1)
                length, own = np.frombuffer(row["length"]), np.frombuffer(row["own"])
                planes = np.frombuffer(row["planes"], dtype=np.uint64).reshape(len(q), PLANES, -1)
                asked = [Query(p, low, step, int(total), size, dim) for p, (low, step, total, size) in zip(planes, np.frombuffer(row["scalars"]).reshape(-1, 4).tolist())]
                ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
                out = [top(vec, query, no, k, nos, ids, x, codes, ones, length, own) for no, vec, query in zip(q_nos, q, asked)]
                sizes = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_nos, sizes), pa.int64()), pa.array(np.repeat(q_ids, sizes), pa.int64()), pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))],
                    ["query_no", "query_id", "vec_id", "score"],
                )

    blocks = stage(usable.mapInArrow(index, "nos binary, ids binary, x binary, codes binary, length binary, own binary"), "ann-index")
    # queries are taken from the stored index, so a row has one number in both
    asked = blocks.select("nos", "ids", "x").mapInArrow(pick, "no long, id long, q binary").repartition(-(-n_queries // query_block), "no")
    asked = stage(asked.mapInArrow(pack, "q_nos binary, q_ids binary, q binary, planes binary, scalars binary"), "ann-queries")
    found = blocks.crossJoin(asked).mapInArrow(scan, "query_no long, query_id long, vec_id long, score double")
    near = Window.partitionBy("query_no").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
