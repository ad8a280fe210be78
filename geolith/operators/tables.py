"""Tables in the folder that the cluster shares, joins of checked size, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow columns up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one, as in tests, gets a temporary folder; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


class Stored:
    """Tables written to the shared folder, each computed once; executors that are lost lose none of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame, rows_a_file: int = 0) -> DataFrame:
        """``rows_a_file``: for rows of many MB, as a reader takes thousands of a file's rows at once; 0: no limit."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def release(self) -> None:
        """Let the files of exchanges go that only tables written before needed."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if path := self.paths.pop(id(df), None):
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows; beyond that joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, stored: Stored) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with, for each node of ``edges`` (columns a, b).

    Alternates two contractions until no edge changes: every node's larger neighbours, then its smaller
    ones, are linked with the smallest node around it. Neither gathers a node's neighbours in one place.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        following = stored(large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lower).distinct())
        new = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        stored.drop(edges, large)
        edges = following
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        state = new
