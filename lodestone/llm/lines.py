"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import materialize

#: Boilerplate lines are broadcast up to so many (8 bytes each), joined by shuffle beyond.
BROADCAST_LINES = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, null without one."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def hashes(text: Column) -> Column:
    """Hash of each line, null for blank ones."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(x)))


def boilerplate(pages: DataFrame, ratio: float, least: int, host_col: str, text_col: str) -> DataFrame:
    """(host, lines): for each host that has any, the hashes of its boilerplate lines.

    A line counts once a page. Counts are summed before they are shuffled, by host and
    line together, so that a hot host is spread over its lines. A host has fewer than
    (mean lines of its pages) / ratio such lines, whatever its size.
    """
    pages = pages.select(F.col(host_col).alias("host"), F.array_distinct(F.array_compact(hashes(F.col(text_col)))).alias("h"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = counts.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("c.host").agg(F.collect_list("h").alias("lines"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.1, least: int = 5, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """pages with the lines dropped that more than ``ratio`` of their host's pages contain.

    Columns stay, with kept in place of text and n_lines, n_dropped added. A line on
    fewer than ``least`` pages of its host stays (so that hosts of fewer pages keep all
    lines), and so do blank lines. A null host is a
    host; a null text stays null with 0 lines; an empty text is one blank line. Repeated
    rows are pages of their own. Lines are equal if their text is.
    """
    bad = materialize(boilerplate(pages, ratio, least, host_col, text_col), "boilerplate").withColumnsRenamed({"host": "__host", "lines": "__bad"})
    if (bad.agg(F.sum(F.size("__bad"))).first()[0] or 0) <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    rows = pages.join(bad, F.col(host_col).eqNullSafe(F.col("__host")), "left").drop("__host")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__bad"), F.xxhash64(x)))
    rows = rows.withColumn("__kept", F.when(F.col("__bad").isNull(), lines).otherwise(kept))
    n = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines)), F.lit(0))
    left = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("__kept")), F.lit(0))
    rows = rows.withColumns({"n_lines": n.cast("long"), "n_dropped": (n - left).cast("long")})
    return rows.withColumn(text_col, F.array_join("__kept", "\n")).drop("__bad", "__kept")


def digests(docs: DataFrame, ratio: float = 0.1, least: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, n_kept_chars, kept_sha256) of drop_boilerplate(); null text counts as empty."""
    rows = drop_boilerplate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), ratio, least)
    kept = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "n_lines", "n_dropped", F.length(kept).cast("long").alias("n_kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
