"""Sessions, and the package's path on Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Bytes that pass between the JVM and a Python worker at a time, or one row.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started.

    Workers get the folder on their PYTHONPATH; where an executor has the
    package from elsewhere (``--py-files``, an installed wheel), a path that it
    does not have does no harm.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """The session with workers that take a few MB at a time, so what they hold
    follows neither the rows of a partition nor their length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share
    (``spark.checkpoint.dir``), deleted when the session's JVM ends.

    Only a local session that has none set gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    out = f"{shared}/textloom/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its scan has fewer partitions than those.

    For work that costs far more than moving the rows, such as regular
    expressions over texts in a table of one or two row groups.  A table with
    partitions enough is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if parts >= cores else df.repartition(cores)
