"""What iterative operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; only one machine without one gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="loomweb-")
    spark.sparkContext.setCheckpointDir(base)


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends at files that every machine can read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Compressed Parquet in the folder of reliable checkpoints, read back: for large tables, of which each later step reads
    a few columns. Shuffle files of the write go as it ends; the table goes when the driver ends."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/kept-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a kept table that nothing still to be computed reads."""
    _delete(df.sparkSession, df._kept_path)


#: Whether Spark deletes the shuffle files of a run when the run ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended, and its folder is the cluster's to clear
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Have the session send pages to Python by the MB: a parsed page is many times its HTML, and a worker keeps what it
    has once taken."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in as many partitions as there are cores, if it comes in fewer: parsing pages outweighs moving them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
