"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks that separate words: space and tab to carriage return.  The
#: ``split()`` of Python's ``bytes`` parts at the same six characters.
BLANK = r"[\x20\x09-\x0D]+"
#: Delete a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in a local session that has none set (tests) a local folder is made
    and put there; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    out = f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def drop_path(spark: SparkSession, out: str) -> None:
    """Delete a staged table that nothing lazy reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor.  The shuffle
    files of the write are deleted once it has ended, as nothing reads them
    again, so a query of many steps holds those of one step at a time.
    """
    spark = df.sparkSession
    out = fresh_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(out)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(out)


def id_residue(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(col.cast("string")) % mod, F.lit(0))


#: Rows of a few numbers each that may be broadcast.
MOST_BROADCAST = 500_000


def narrow(keys: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A staged table of a few numbers a row, broadcast if it is small, so that
    what it is joined to need not be shuffled; beyond, Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= most else keys


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def most_frequent(counts: DataFrame, n_col: str, most: int) -> DataFrame:
    """The rows of the highest counts, ``most`` at most in all.

    Counts are ranked by 64ths of an octave: a histogram of at most some
    thousand rows gives the lowest rank that still fits, so no task sends more
    to the driver than is wanted in the end.
    """
    rank = F.floor(F.log2(F.col(n_col).cast("double")) * 64)
    room, least = most, None
    for row in counts.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rank")).collect():
        if row["rows"] > room:
            break
        room, least = room - row["rows"], row["rank"]
    return counts.filter(F.lit(False) if least is None else rank >= least)


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers serve one
    stage after the other and would hold on to the largest one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
