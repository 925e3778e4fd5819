"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session whose executors are threads of the driver has a default."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, but columnar: later readers prune
    columns, and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, path: str) -> tuple:
    """What a path holds: itself, and the files, bytes and latest change below it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, n, size, latest = fs.listFiles(p, True), 0, 0, 0
    while files.hasNext():
        f = files.next()
        n, size, latest = n + 1, size + f.getLen(), max(latest, f.getModificationTime())
    return path, n, size, latest


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has ``most`` rows at most; beyond, Spark chooses another join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Workspace:
    """Intermediate tables that go when the work on them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """materialize(), to be removed by close()."""
        path = fresh_dir(self.spark, label)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths:
            drop_shared(self.spark, path)
        self.paths.clear()


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove a folder made by fresh_dir."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
