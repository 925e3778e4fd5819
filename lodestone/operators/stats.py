"""Counts, coverage and health of an index, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"))


def file_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.count("*").alias("chunks"), F.max("updated_at").alias("last_updated")).orderBy(F.desc("last_updated"), "file_path")


def extension_counts(files: DataFrame) -> DataFrame:
    ext = T.extension(F.col("file_path"))
    return files.select("file_path").distinct().groupBy(F.when(ext == "", "(none)").otherwise(ext).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext")


def mean_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks a file to one decimal, 0 without files."""
    one = index_stats(chunks)
    return one.select(F.when(F.col("files") > 0, F.floor(F.col("chunks") / F.col("files") * 10 + 0.5) / 10).otherwise(F.lit(0.0)).alias("mean_chunks"))


def coverage(indexed: DataFrame, eligible: DataFrame, warn: int = 75) -> DataFrame:
    """(indexed, eligible, percent, low): share of the eligible files that is indexed, null without any."""
    n = indexed.agg(F.countDistinct("file_path").alias("indexed")).crossJoin(eligible.agg(F.countDistinct("file_path").alias("eligible")))
    percent = F.when(F.col("eligible") > 0, F.floor(100 * F.col("indexed") / F.col("eligible") + 0.5))
    return n.withColumn("percent", percent.cast("int")).withColumn("low", F.coalesce(F.col("percent") < warn, F.lit(False)))


def health(chunks: DataFrame, status: str, stored_dims: int | None, dims: int) -> DataFrame:
    """(ok, files, chunks, status, dimension_mismatch): ok with files, no error and the vectors' length as configured."""
    wrong = stored_dims is not None and stored_dims != dims
    return index_stats(chunks).select(
        ((F.col("files") > 0) & F.lit(status != "error" and not wrong)).alias("ok"), "files", "chunks", F.lit(status).alias("status"), F.lit(wrong).alias("dimension_mismatch")
    )


def progress(state: DataFrame) -> DataFrame:
    """Percent done and whether a run in progress is stale (5 minutes without end, or from the future).

    state: (sync_status, completed, total, started_at, now).
    """
    spent = F.unix_timestamp("now") - F.unix_timestamp("started_at")
    stale = (F.col("sync_status") == "in_progress") & ((spent > 300) | (spent < 0))
    return state.withColumn("percent", F.when(F.col("total") > 0, F.floor(100 * F.col("completed") / F.col("total") + 0.5)).cast("int")).withColumn("stale", stale)


def size_text(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d bytes", n))
        .when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / 1048576.0))
    )


def age_text(then: Column, now: Column) -> Column:
    """Time since, in words; never without one."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda div, name: F.concat(F.floor(s / div).cast("string"), F.lit(f" {name}"), F.when(F.floor(s / div) == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(then.isNull(), "never").when(s < 60, "just now").when(s < 3600, unit(60, "minute"))
        .when(s < 86400, unit(3600, "hour")).otherwise(F.concat(F.lit("about "), unit(86400, "day")))
    )


def short_age(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda div, u: F.concat(F.lit("~"), F.floor(s / div).cast("string"), F.lit(u))
    return F.when(then.isNull(), "").when(s < 60, "~now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def grid(counts: DataFrame, eligible: int, cells: int = 20) -> DataFrame:
    """counts (ext, files) with ``cells``: each extension's rounded share of the grid."""
    return counts.withColumn("cells", F.floor(F.col("files") / F.lit(max(1, eligible)) * cells + 0.5).cast("int") if eligible else F.lit(0))


def hit_rows(hits: DataFrame, chars: int, ellipsis: str = "") -> DataFrame:
    """Hits as shown: lines a-b, similarity and score to three decimals, the beginning of the text."""
    three = lambda c: F.round(F.col(c), 3).alias(c)
    return hits.select("query_id", "rank", F.col("file_path").alias("file"), F.concat_ws("-", "start_line", "end_line").alias("lines"), three("similarity"), three("score"), T.preview(F.col("chunk_text"), chars, ellipsis).alias("preview"))
