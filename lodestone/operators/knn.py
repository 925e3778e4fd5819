"""Exact cosine search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.plans.storage import small


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double arithmetic over the shorter length; 0 if either has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    sizes = norm(a) * norm(b)
    return F.when(sizes > 0, dot(a, b) / sizes).otherwise(F.lit(0.0))


def nearest(chunks: DataFrame, queries: DataFrame, k: int, prefix: str | None = None, prefix_mode: str = "compat", threshold: float | None = None) -> DataFrame:
    """(query_id, chunk_id, file_path, similarity, vec_rank): the k chunks nearest to each query vector.

    The queries are a small table beside the chunks, met by each chunk where it is; only
    each query's best are shuffled. With a prefix, ``compat`` takes it from the 4k
    nearest and may give fewer than k, ``exact`` from all. Equal ones go by chunk_id.
    Chunks without a vector are left out.
    """
    rows = chunks.select("chunk_id", "file_path", "embedding").where("embedding is not null")
    inside = F.lit(True) if not prefix else F.col("file_path").startswith(prefix)
    if prefix and prefix_mode == "exact":
        rows = rows.where(inside)
    met = rows.crossJoin(small(queries.select("query_id", "vec")))
    met = met.select("query_id", "chunk_id", "file_path", cosine(F.col("embedding"), F.col("vec")).alias("similarity"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "chunk_id")
    wide = 4 * k if prefix and prefix_mode != "exact" else k
    met = met.withColumn("near", F.row_number().over(order)).where(F.col("near") <= wide)
    if threshold is not None:
        met = met.where(F.col("similarity") >= threshold)
    if wide > k:
        met = met.where(inside)
    met = met.withColumn("vec_rank", F.row_number().over(W.partitionBy("query_id").orderBy("near"))).where(F.col("vec_rank") <= k)
    return met.select("query_id", "chunk_id", "file_path", "similarity", "vec_rank")
