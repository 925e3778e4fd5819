"""Shared parts of the operators: tables, batches, shared files, key ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers hold: long texts come in few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def key_cuts(df: DataFrame, key: str, rows_per_range: int, most: int = 1 << 18, level: int = 2048) -> list:
    """Ascending distinct key values that cut ``df`` into ranges of about equal row counts.

    Each cut is a value that occurs, and is the last of its range. Only the key
    column is read. Beyond ``level`` ranges each of them is cut again by its own
    quantiles. What comes to the driver is at most ``most`` numbers (beyond that,
    ranges hold more rows and their sorts spill).
    """
    n = df.select(F.count(key)).first()[0]
    parts = min(most, -(-n // rows_per_range))
    if parts < 2:
        return []
    shares = lambda k: F.array(*[F.lit(i / k) for i in range(1, k)])
    first = min(level, parts)
    cuts = sorted(set(df.select(F.percentile_approx(key, shares(first), F.lit(20_000)).alias("c")).first()["c"]))
    if parts > level:
        more = df.select(range_of(F.col(key), cuts).alias("range"), F.col(key).alias("k")).where("k is not null")
        more = more.groupBy("range").agg(F.percentile_approx("k", shares(-(-parts // level)), F.lit(2_000)).alias("c"))
        cuts = sorted({*cuts, *(x for r in more.toLocalIterator() for x in r["c"])})
    return cuts


def constant(values: list, kind: str = "array<bigint>") -> Column:
    """Numbers as one constant of the plan, however many they are."""
    return F.from_json(F.lit(str(values)), kind)


def range_of(key: Column, cuts: list) -> Column:
    """Index of the range (cut i is the last key of range i); null keys count as the least.

    The cuts are one constant of the plan, in blocks of about their root.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    outer, inner = constant([b[-1] for b in blocks]), constant(blocks, "array<array<bigint>>")
    block = F.size(F.filter(outer, lambda c: c < key))
    within = F.size(F.filter(F.coalesce(F.get(inner, block), F.array().cast("array<bigint>")), lambda c: c < key))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.least(block * step + within, F.lit(len(cuts))))


def arrow_rows(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
