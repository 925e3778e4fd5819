"""Hybrid search: vector and full-text candidates fused, weighed, boosted along the graph and cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone import config as C
from lodestone.functions import fixed as V
from lodestone.functions import text as T
from lodestone.operators.fulltext import TextIndex, bm25, normalized
from lodestone.operators.graph import pagerank, top_seeds
from lodestone.operators.knn import cosine, nearest
from lodestone.plans.storage import materialize, small

OUT = ("query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", "similarity", "score")


def fuse(vec: DataFrame, fts: DataFrame) -> DataFrame:
    """Candidates of either side with what each says of them; similarity 0 without a vector hit."""
    v = vec.select("query_id", "chunk_id", F.col("similarity").alias("vec_similarity"), "vec_rank")
    f = normalized(fts).select("query_id", "chunk_id", "bm25", "bm25_norm", "fts_rank")
    return v.join(f, ["query_id", "chunk_id"], "full_outer").withColumn("similarity", F.coalesce("vec_similarity", F.lit(0.0)))


def base_score(wv: float = V.WEIGHT_VECTOR, wb: float = V.WEIGHT_BM25, wr: float = V.WEIGHT_RRF) -> Column:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sides = wv * zero("vec_similarity") + wb * zero("bm25_norm") + wr * T.rrf(F.col("vec_rank"), F.col("fts_rank"))
    return sides * F.col("multiplier") * F.col("boost")


def with_weights(rows: DataFrame) -> DataFrame:
    """rows (file_path, chunk_text, query_text) with the weights of file and identifiers."""
    return rows.withColumn("multiplier", T.file_multiplier(F.col("file_path"))).withColumn("boost", T.identifier_boost(F.col("query_text"), F.col("chunk_text")))


def candidates(chunks: DataFrame, index: TextIndex, queries: DataFrame, k: int, prefix: str | None, weights: tuple, prefix_mode: str = "compat") -> DataFrame:
    """Scored candidates before graph and file boosts: 2k of each side. ``place`` is their order among equals."""
    vec = nearest(chunks, queries, 2 * k, prefix, prefix_mode)
    fts = bm25(index, queries, prefix).where(F.col("fts_rank") <= 2 * k)
    rows = chunks.join(small(fuse(vec, fts)), "chunk_id").join(small(queries), "query_id")
    rows = with_weights(rows).withColumn("score", base_score(*weights))
    side = F.when(F.col("vec_rank").isNotNull(), F.struct(F.lit(0).alias("side"), F.col("vec_rank").alias("at"))).otherwise(F.struct(F.lit(1).alias("side"), F.col("fts_rank").alias("at")))
    return rows.withColumn("place", side).withColumn("via_graph", F.lit(False)).withColumn("ppr", F.lit(None).cast("double"))


def expand(rows: DataFrame, ranks: DataFrame, chunks: DataFrame, queries: DataFrame, wv: float, wg: float, n: int, least: float, prefix: str | None = None) -> DataFrame:
    """The best chunk of each of the n highest ranked files that no candidate is of."""
    reached = ranks.where(F.col("ppr") >= least).withColumnRenamed("node", "file_path").join(rows.select("query_id", "file_path").distinct(), ["query_id", "file_path"], "left_anti")
    if prefix:
        reached = reached.where(F.col("file_path").startswith(prefix))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("ppr", 9)), "file_path"))
    reached = reached.withColumn("nth", nth).where(F.col("nth") <= n)
    found = chunks.join(reached, "file_path").join(small(queries), "query_id").withColumn("similarity", cosine(F.col("embedding"), F.col("vec")))
    best = F.row_number().over(W.partitionBy("query_id", "file_path").orderBy(F.desc(F.round("similarity", 9)), "chunk_id"))
    found = with_weights(found.withColumn("best", best).where("best = 1"))
    score = wv * F.col("similarity") * F.col("multiplier") * F.col("boost") * (1 + wg * F.col("ppr"))
    place = F.struct(F.lit(2).alias("side"), F.col("nth").alias("at"))
    return found.withColumn("score", score).withColumn("via_graph", F.lit(True)).withColumn("place", place)


def finish(rows: DataFrame, k: int, threshold: float, debug: bool = False) -> DataFrame:
    """Weigh files with several candidates, drop what is below the threshold, keep the k best of each query."""
    n = F.count("*").over(W.partitionBy("query_id", "file_path"))
    rows = rows.withColumn("in_file", n)
    rows = rows.withColumn("score", F.col("score") * F.least(1 + V.FILE_STEP * (F.col("in_file") - 1), F.lit(V.FILE_CAP)))
    rows = rows.where(F.col("via_graph") | (F.col("similarity") >= threshold) | ((F.col("similarity") == 0) & (F.col("score") > 0)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "place"))).where(F.col("rank") <= k)
    if not debug:
        return rows.select(*OUT)
    parts = ["vec_rank", "fts_rank", "bm25", "bm25_norm", "multiplier", "boost", "ppr", "in_file", "via_graph"]
    return rows.select(*OUT, F.struct(*[c for c in parts if c in rows.columns]).alias("debug"))


def hybrid_search(chunks: DataFrame, index: TextIndex, queries: DataFrame, edges=None, options: dict | None = None, k: int = 10, threshold: float = 0.35, prefix: str | None = None, prefix_mode: str = "compat", filter_expansion: bool = True) -> DataFrame:
    """Ranked hits of queries (query_id, query_text, vec) over chunks (chunk_id, file_path, chunk_text, start_line, end_line, embedding) and their full-text index.

    Scores fuse similarity, full text and reciprocal ranks; with ``edges`` (of files, or
    a graph that pagerank() takes) and a graph weight, files near the best ones are
    boosted, and files that are only near them added (within the prefix, unless
    ``filter_expansion`` is off).
    """
    o = C.merged(C.DEFAULTS["search"]["hybrid"], options or {})
    weights = o["weight_vector"], o["weight_bm25"], o["weight_rrf"]
    rows = candidates(chunks, index, queries, k, prefix, weights, prefix_mode)
    wg = o["weight_graph"]
    if edges is not None and wg > 0:
        rows = materialize(rows, "hybrid")
        ranks = materialize(pagerank(edges, top_seeds(rows, o["graph_seeds"])), "hybrid-ranks")
        rows = rows.drop("ppr").join(ranks.withColumnRenamed("node", "file_path"), ["query_id", "file_path"], "left")
        rows = rows.withColumn("score", F.col("score") * (1 + wg * F.coalesce("ppr", F.lit(0.0))))
        if o["graph_expand"] > 0:
            more = expand(rows, ranks, chunks, queries, o["weight_vector"], wg, o["graph_expand"], o["graph_expand_min"], prefix if filter_expansion else None)
            rows = rows.unionByName(more, allowMissingColumns=True)
    return finish(rows, k, threshold, o["debug"])


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.35, prefix: str | None = None, prefix_mode: str = "compat") -> DataFrame:
    """Hits by vector alone; there is no score."""
    found = nearest(chunks, queries, k, prefix, prefix_mode, threshold)
    rows = found.join(chunks.select("chunk_id", "start_line", "end_line"), "chunk_id").withColumnRenamed("vec_rank", "rank")
    return rows.withColumn("score", F.lit(None).cast("double")).select(*OUT)


def merge_adjacent(hits: DataFrame, gap: int = V.MERGE_GAP, by: str = "query_id") -> DataFrame:
    """Hits of one file whose lines touch, or are ``gap`` lines apart at most, as one: widest range, best score and similarity, preview of the best.

    hits: (query_id, file_path, start_line, end_line, similarity, score, preview).
    """
    lines = W.partitionBy(by, "file_path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(lines.rowsBetween(W.unboundedPreceding, -1))
    rows = hits.withColumn("new", F.coalesce((F.col("start_line") > reach + gap).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(lines))
    best = F.struct(F.round(F.coalesce("score", "similarity"), 3).alias("s"), (-F.col("start_line")).alias("first"))
    return rows.groupBy(by, "file_path", "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("similarity").alias("similarity"), F.max("score").alias("score"),
        F.max_by("preview", best).alias("preview"), F.count("*").alias("merged"),
    ).drop("island")
