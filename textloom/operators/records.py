"""Index records, identities and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import trim_ws

#: Fixed value: records in one upsert batch.
BATCH = 90


def natural_id(*key: str) -> Column:
    """The same record gets the same id in every index and run."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)), 256)


def random_id() -> Column:
    return F.uuid()


def dense_records(chunks: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """id, chunk_text (as it is, blank ones too) and the other columns."""
    rest = [c for c in chunks.columns if c != "chunk"]
    return chunks.select(natural_id(*key).alias("id"), F.coalesce("chunk", F.lit("")).alias("chunk_text"), *rest)


def sparse_records(chunks: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """id, chunk_text (the first text there is, stripped) and the other
    columns; rows whose text is blank go.  An id that is there stays."""
    texts = [c for c in ("chunk_text", "chunk", "text") if c in chunks.columns]
    rest = [c for c in chunks.columns if c not in {*texts, "id"}]
    text = trim_ws(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in texts)))
    made = natural_id(*key)
    own = F.coalesce(F.nullif(F.col("id"), F.lit("")), made) if "id" in chunks.columns else made
    return chunks.select(own.alias("id"), text.alias("chunk_text"), *rest).filter(F.col("chunk_text") != "")


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(row, number): each row's number in ``order`` within its ``by``, from 1.

    Two passes over ranges of (by, order): each range's rows, then the sum of
    the ranges before it, so no task sees all rows of one key.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"row.{c}") for c in by]
    ranged = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")).repartitionByRange(width, *keys, *(F.col(f"row.{c}") for c in order))
    ranged = ranged.select("row", F.spark_partition_id().alias("part"), F.struct(F.lit(0).alias("all"), *keys).alias("key"))
    counts = ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))  # a row a range and key in it
    so_far = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    own = Window.partitionBy("part", "key").orderBy(*(F.col(f"row.{c}") for c in order))
    return ranged.withColumn("k", F.row_number().over(own)).join(before, ["key", "part"]).select("row", (F.col("before") + F.col("k")).alias("number"))


def sequential_ids(rows: DataFrame, *order: str) -> DataFrame:
    """``id_1``, ``id_2``, ... in the given order."""
    return _numbered(rows, [], list(order)).select(F.concat(F.lit("id_"), "number").alias("id"), "row.*")


def upsert_batches(records: DataFrame, by: str, order: str, size: int = BATCH) -> DataFrame:
    """The records with the number of their batch within ``by``."""
    return _numbered(records, [by], [order]).select("row.*", F.floor((F.col("number") - 1) / size).cast("long").alias("batch"))


def write_index(records: DataFrame, path: str, index_name: str, namespace: str = "__default__") -> None:
    """Write the records to an index table, one folder for each index and
    namespace; a record replaces the one with the same id.

    Of records that share an id one is written.  The folder is rewritten as a
    whole and put in place when the write has ended.
    """
    spark = records.sparkSession
    new = records.dropDuplicates(["id"])
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/index_name={index_name}/namespace={namespace}")
    if own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own):
        old = spark.read.parquet(path).filter((F.col("index_name") == index_name) & (F.col("namespace") == namespace)).drop("index_name", "namespace")
        new = old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    out = new.withColumn("index_name", F.lit(index_name)).withColumn("namespace", F.lit(namespace))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_name", "namespace").parquet(path)


def index_stats(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("record_count"))
