"""Index maintenance as streams: changed files are upserted, missing ones collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.globs import eligible
from lodestone.plans import indexing
from lodestone.sources.files import relative

FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, config: dict, ignore: list[str] = (), glob: str | None = None) -> DataFrame:
    """(file_path, content, file_hash) of files as they come or change."""
    i = config["indexing"]
    reader = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    rows = rows.withColumn("file_path", relative(F.col("path"), root))
    rows = rows.where(eligible(F.col("file_path"), F.col("length"), i["include"], i["exclude"], list(ignore), i["max_file_size_kb"]))
    return rows.select("file_path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("mtime"))


def upsert_stream(files: DataFrame, store, config: dict, embedder, checkpoint: str, **trigger):
    """Start a query that brings each batch's files into the index; a batch that is run again changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        newest = rows.groupBy("file_path").agg(F.max_by(F.struct("content", "file_hash"), "mtime").alias("f")).select("file_path", "f.*")
        indexing.upsert_files(store, newest, config, embedder)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def gc_stream(spark: SparkSession, engine, checkpoint: str, every: str = "60 seconds"):
    """Start a query that collects the rows of missing files, at most once in ``every``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def batch(_rows: DataFrame, _id: int) -> None:
        engine.gc()

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def upsert_latest(events: DataFrame, keys: list[str], order: str, out: str, checkpoint: str):
    """Start a query that keeps the newest row of each key of a stream of changes in a table at ``out``, written anew each batch."""

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        if n and _exists(spark, f"{out}/{n - 1}"):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{out}/{n - 1}"))
        cols = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, F.xxhash64(*cols))).alias("r"))
        newest.select(*keys, "r.*").select(rows.columns).write.mode("overwrite").parquet(f"{out}/{n}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
