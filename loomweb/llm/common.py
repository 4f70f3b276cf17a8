"""What the operators share: scratch tables in the cluster's shared folder, connected components, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's decimal text, modulo parts."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


#: Bytes and rows of an Arrow batch of texts: a task then holds a few of them, however long the texts are.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send texts to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Whether Spark deletes the shuffle files of a run when the run ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the folder that all machines share, and deleted when the driver ends.

    The folder is the session's spark.checkpoint.dir. Only where that is unset (tests on one machine) a temporary
    folder is made. Every table is Parquet, so a lost executor costs a reread and no recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="loomweb-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/loomweb-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return it read back: its lineage starts at the files.

        Spark deletes the shuffle files of the write as it ends, not when the driver happens to collect what refers to
        them. Other runs of the session keep its own setting.
        """
        path = f"{self.base}/{self.count:03d}-{name}"
        self.count += 1
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def clear(self) -> None:
        """Delete all tables; results that read them can't be computed any more."""
        if self.spark.sparkContext._jsc is not None:  # else the session has ended, and its folder is the cluster's to clear
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing still to be computed reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every end of the edges (src, dst); the component is its smallest id.

    Alternates the large-star and small-star steps until the edges no longer change. A step is one partial
    minimum per node and one join, so a node with very many neighbours is summed on the map side and its join
    partition can be split. Null ends and loops are left out; repeated edges count once; no edge, no row.
    """
    cur = scratch.keep(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = scratch.keep(small, "small")
        scratch.drop(large)
        scratch.drop(cur)
        cur, after = nxt, state(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
