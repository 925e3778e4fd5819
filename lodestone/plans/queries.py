"""Queries over the driver's tables, which stand in for the tables of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed as V
from lodestone.functions import globs, text as T
from lodestone.operators import chunking, fulltext, fusion, graph, knn, lookup, route, stats, symbols
from lodestone.plans.fixtures import CODE, COMMANDS, DIRECTORIES, FTS_QUERIES, PATHS, REQUESTS, SENTENCES
from lodestone.plans.storage import fresh_dir, materialize, version
from lodestone.sources import files as S
from lodestone.sources import snapshot as N
from lodestone.sources.embedding import HashEmbedder, embed_column

#: Full-text indexes of this session, by input and kind: written once, then read by the queries' terms.
_INDEXES: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector_chunks(spark, sf) -> DataFrame:
    path = F.concat(F.lit("src/m"), F.col("label").cast("string"), F.lit("/f"), (F.col("vec_id") % 20).cast("string"), F.lit(".ts"))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), path.alias("file_path"), "embedding", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))


def vector_queries(spark, sf, below: int) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") < below).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def doc_path():
    ext = F.element_at(F.array(*map(F.lit, ("ts", "md", "test.ts", "json", "py"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return F.concat_ws("/", "source", "lang", F.concat_ws(".", F.col("doc_id").cast("string"), ext))


def doc_files(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", doc_path().alias("file_path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))


def doc_texts(spark, sf) -> DataFrame:
    """Documents as chunks, without vectors: what full text is made of."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), doc_path().alias("file_path"), F.col("text").alias("chunk_text"))
    return docs.withColumn("identifiers", T.identifiers(F.col("chunk_text")))


def doc_chunks(spark, sf) -> DataFrame:
    """Documents as chunks, with the vector of the same number where there is one."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    rows = doc_texts(spark, sf).join(vectors, "chunk_id", "left")
    return rows.select("chunk_id", "file_path", "chunk_text", "identifiers", F.lit(1).alias("start_line"), F.size(F.split("chunk_text", "\n")).alias("end_line"), "embedding")


def doc_index(spark, sf, stem: bool = False) -> fulltext.TextIndex:
    """The stored full-text index of the documents: path, text and identifiers."""
    key = spark.sparkContext.applicationId, version(spark, f"{sf}/documents.parquet"), stem
    if key not in _INDEXES:
        _INDEXES[key] = fulltext.write_index(doc_texts(spark, sf), fresh_dir(spark, "text-index"), stem=stem)
    return _INDEXES[key]


def text_queries(spark) -> DataFrame:
    return spark.createDataFrame(FTS_QUERIES, "query_id int, query_text string")


def both_queries(spark, sf) -> DataFrame:
    return text_queries(spark).join(vector_queries(spark, sf, 100), "query_id")


def code_files(spark) -> DataFrame:
    return spark.createDataFrame(CODE, "file_path string, content string")


def code_symbols(spark) -> DataFrame:
    return symbols.definitions(code_files(spark))


def code_refs(spark) -> DataFrame:
    return symbols.references(code_files(spark), code_symbols(spark))


def doc_defs(spark, sf) -> DataFrame:
    """First word of each line as a definition."""
    lines = doc_files(spark, sf).select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    name = F.regexp_extract(F.lower("line"), r"^([a-z]+)", 1)
    return lines.select("file_path", name.alias("name"), F.lit("word").alias("kind"), (F.col("i") + 1).alias("line")).where("name <> ''")


def doc_refs(spark, sf) -> DataFrame:
    """Words of five letters or more as references."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(\p{L}{5,})"), F.lit(1)))
    return doc_files(spark, sf).select("file_path", F.explode(words).alias("name"))


def _six(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


# kNN ------------------------------------------------------------------------


def knn_topk(spark, sf):
    return _six(knn.nearest(vector_chunks(spark, sf), vector_queries(spark, sf, 1), 10), "similarity")


def knn_threshold(spark, sf):
    return _six(fusion.vector_search(vector_chunks(spark, sf), vector_queries(spark, sf, 3), 10, 0.2), "similarity").drop("score")


def knn_prefix_compat(spark, sf):
    return _six(knn.nearest(vector_chunks(spark, sf), vector_queries(spark, sf, 3), 10, "src/m1/"), "similarity")


def knn_prefix_exact(spark, sf):
    return _six(knn.nearest(vector_chunks(spark, sf), vector_queries(spark, sf, 3), 10, "src/m1/", "exact"), "similarity")


def knn_multi_query(spark, sf):
    return _six(knn.nearest(vector_chunks(spark, sf), vector_queries(spark, sf, 5), 10), "similarity")


# Full text ------------------------------------------------------------------


def _bm25(spark, sf, **options):
    stem = options.pop("stem", False)
    return _six(fulltext.bm25(doc_index(spark, sf, stem), text_queries(spark), **options).drop("file_path"), "bm25")


def bm25_or(spark, sf):
    return _bm25(spark, sf, tiers="any")


def bm25_and(spark, sf):
    return _bm25(spark, sf, tiers="all")


def bm25_tiered(spark, sf):
    return _bm25(spark, sf)


def bm25_prefix(spark, sf):
    return _bm25(spark, sf, prefix="SRC1/")


def bm25_porter(spark, sf):
    return _bm25(spark, sf, stem=True)


def bm25_phrase(spark, sf):
    wanted = fulltext.phrases(fulltext.compile_queries(text_queries(spark)))
    rows = fulltext.phrase_counts(doc_index(spark, sf), wanted)
    return rows.select("query_id", "phrase", "chunk_id", "tf")


def lexical_search(spark, sf):
    return _six(fulltext.lexical_search(doc_chunks(spark, sf), doc_index(spark, sf), text_queries(spark)), "score")


# Fusion ---------------------------------------------------------------------


def rrf_fusion(spark, sf):
    chunks, queries = doc_chunks(spark, sf), both_queries(spark, sf)
    rows = fusion.fuse(knn.nearest(chunks, queries, 20), fulltext.bm25(doc_index(spark, sf), queries).where("fts_rank <= 20"))
    rows = rows.select("query_id", "chunk_id", "similarity", "vec_rank", "bm25_norm", "fts_rank", T.rrf(F.col("vec_rank"), F.col("fts_rank")).alias("rrf"))
    return _six(rows, "similarity", "bm25_norm", "rrf")


def _hybrid(spark, sf, edges=None, **options):
    chunks = doc_chunks(spark, sf)
    return fusion.hybrid_search(chunks, doc_index(spark, sf), both_queries(spark, sf), edges, {"weight_graph": 0 if edges is None else 1.0, **options}, threshold=0.05)


def hybrid_search(spark, sf):
    return _six(_hybrid(spark, sf), "similarity", "score")


def hybrid_batch(spark, sf, each: int = 2):
    """Hybrid search of ``each`` queries a benchmark item (its first words, with some vector): what the bench takes throughput from."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    items = table(spark, sf, "benchmark").select("item_id", words.alias("w"))
    n = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    rows = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("i"))
    rows = rows.select((F.col("item_id") * each + F.col("i")).cast("int").alias("query_id"), F.array_join(F.slice("w", F.col("i") * 4 + 1, F.lit(4)), " ").alias("query_text"))
    vectors = table(spark, sf, "embeddings").select((F.col("vec_id") % n).alias("v"), F.col("embedding").alias("vec"))
    queries = materialize(rows.join(vectors, (F.col("query_id") * 7) % n == F.col("v")).drop("v"), "queries")
    return fusion.hybrid_search(doc_chunks(spark, sf), doc_index(spark, sf, True), queries, None, {"weight_graph": 0}, threshold=0.05)


def hybrid_debug(spark, sf):
    rows = _hybrid(spark, sf, debug=True).select("query_id", "rank", "chunk_id", "debug.vec_rank", "debug.fts_rank", "debug.multiplier", "debug.boost", "debug.in_file")
    return rows


def hybrid_graph(spark, sf):
    made = doc_graph(spark, sf)
    rows = _hybrid(spark, sf, made)
    made.release()
    return _six(rows, "similarity", "score")


def merged_hits(spark, sf):
    hits = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("query_id"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("file_path"),
        ((F.col("l_orderkey") * 13) % 4000 + 1).cast("int").alias("start_line"), ((F.col("l_orderkey") * 13) % 4000 + 1 + F.col("l_linenumber")).cast("int").alias("end_line"),
        (F.col("l_discount") * 10).alias("similarity"), F.col("l_tax").alias("score"), F.col("l_shipdate").cast("string").alias("preview"),
    ).distinct()
    return fusion.merge_adjacent(hits).drop("preview")


# Text -----------------------------------------------------------------------


def sentences(spark) -> DataFrame:
    return spark.createDataFrame(SENTENCES, "id int, text string")


def identifier_split(spark, sf):
    return sentences(spark).select("id", T.identifiers(F.col("text")).alias("identifiers"))


def fts_query_compile(spark, sf):
    rows = fulltext.compile_queries(sentences(spark), "text")
    return rows.select("id", F.array_join("all_phrases", "|").alias("all_phrases"), F.array_join("any_phrases", "|").alias("any_phrases"))


def identifier_boost(spark, sf):
    a, b = sentences(spark), sentences(spark).select(F.col("id").alias("other"), F.col("text").alias("chunk"))
    return a.join(b, F.abs(F.col("id") - F.col("other")) <= 1).select("id", "other", T.identifier_boost(F.col("text"), F.col("chunk")).alias("boost"))


def paths(spark) -> DataFrame:
    return spark.createDataFrame(PATHS, "file_path string, size long")


def file_type_multiplier(spark, sf):
    return paths(spark).select("file_path", T.file_multiplier(F.col("file_path")).alias("multiplier"))


def synonym_expand(spark, sf):
    words = spark.createDataFrame([(w,) for w in [*V.SYNONYMS, "AUTH", "other"]], "word string")
    return words.select("word", F.explode_outer(T.synonyms(F.col("word"))).alias("synonym"))


def language_of(spark, sf):
    return paths(spark).select("file_path", T.language(F.col("file_path")).alias("language"))


def strip_noise(spark, sf):
    return code_files(spark).select("file_path", symbols.strip_noise(F.col("content")).alias("clean"))


def extract_definitions(spark, sf):
    return code_symbols(spark)


def extract_references(spark, sf):
    return code_refs(spark)


# Lookups --------------------------------------------------------------------


def find_symbol(spark, sf):
    return lookup.find_symbol(doc_defs(spark, sf), "the")


def find_references(spark, sf):
    return lookup.find_references(code_symbols(spark), code_refs(spark), "signIn")


def outline(spark, sf):
    return lookup.outline(code_symbols(spark), "src/auth.ts")


def files_defining(spark, sf):
    return lookup.files_defining(doc_defs(spark, sf), ["the", "thing", "and", "nowhere"])


def path_fragment(spark, sf):
    return lookup.files_matching(doc_defs(spark, sf), "C1/EN/1")


# Graph ----------------------------------------------------------------------


def _graph(spark, sf, damping, most=0):
    # Six decimals, half up, as _six() gives, without a decimal number for each of so many edges.
    return graph.file_graph(doc_refs(spark, sf), doc_defs(spark, sf), damping, most).withColumn("weight", F.floor(F.col("weight") * 1e6 + 0.5) / 1e6)


def file_graph_raw(spark, sf):
    return _graph(spark, sf, "raw")


def file_graph_binary(spark, sf):
    return _graph(spark, sf, "binary")


def file_graph_sqrt(spark, sf):
    return _graph(spark, sf, "sqrt")


def file_graph_max_definers(spark, sf):
    return _graph(spark, sf, "raw", 5)


def _seeds(spark, sf):
    """Each text query's best files."""
    return graph.top_seeds(fulltext.lexical_search(doc_chunks(spark, sf), doc_index(spark, sf), text_queries(spark)), V.DEFAULTS["search"]["hybrid"]["graph_seeds"])


def doc_graph(spark, sf) -> graph.NameGraph:
    return graph.NameGraph(doc_refs(spark, sf), doc_defs(spark, sf))


def _ranks(spark, sf, seeds):
    made = doc_graph(spark, sf)
    ranks = graph.pagerank(made, seeds)
    made.release()
    return ranks


def ppr(spark, sf):
    return _ranks(spark, sf, materialize(_seeds(spark, sf), "seeds")).withColumn("ppr", F.round("ppr", 4))


def graph_expand(spark, sf):
    seeds = materialize(_seeds(spark, sf), "expand-seeds")
    ranks = _ranks(spark, sf, seeds).join(seeds.select("query_id", "node"), ["query_id", "node"], "left_anti").where("ppr >= 0.05")
    from pyspark.sql.window import Window as W

    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("ppr", 9)), "node"))
    return ranks.withColumn("nth", nth).where("nth <= 3").select("query_id", "node", "nth", F.round("ppr", 4).alias("ppr"))


# Chunks ---------------------------------------------------------------------


def chunk_fixed(spark, sf):
    rows = chunking.fixed_chunks(doc_files(spark, sf), 64, 8)
    return rows.select("file_path", "chunk_index", "start_line", "end_line", F.md5("chunk_text").alias("md5"))


def chunk_syntax(spark, sf):
    return chunking.chunks(code_files(spark), "syntax").select("file_path", "chunk_index", "start_line", "end_line", F.md5("chunk_text").alias("md5"))


def chunk_hybrid(spark, sf):
    return chunking.chunks(code_files(spark), "hybrid", 20, 4).select("file_path", "chunk_index", "start_line", "end_line", F.md5("chunk_text").alias("md5"))


def preamble_claim(spark, sf):
    lines = code_files(spark).select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("file_path", (F.col("i") + 1).alias("n"), "line")
    return chunking.preamble_starts(lines).where("boundary").select("file_path", "n", "start")


# Index ----------------------------------------------------------------------


def line_chunks(spark, sf) -> DataFrame:
    """A chunk a line of the documents."""
    rows = doc_files(spark, sf).select("doc_id", "file_path", F.posexplode(F.split("content", "\n")).alias("chunk_index", "chunk_text"))
    return rows.withColumn("file_hash", F.md5("chunk_text")).withColumn("updated_at", F.timestamp_seconds(F.col("doc_id") * 60 + F.col("chunk_index")))


def index_stats(spark, sf):
    return stats.index_stats(line_chunks(spark, sf))


def file_stats(spark, sf):
    return stats.file_stats(line_chunks(spark, sf)).withColumn("last_updated", F.unix_timestamp("last_updated"))


def ext_counts(spark, sf):
    return stats.extension_counts(doc_files(spark, sf))


def ext_grid(spark, sf):
    files = doc_files(spark, sf)
    return stats.grid(stats.extension_counts(files), files.count())


def mean_chunks(spark, sf):
    return stats.mean_chunks(line_chunks(spark, sf))


def coverage(spark, sf):
    return stats.coverage(line_chunks(spark, sf).where("doc_id % 3 <> 0"), doc_files(spark, sf))


def health(spark, sf):
    return stats.health(line_chunks(spark, sf), "idle", 64, 64)


def sync_progress(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "in_progress").otherwise("idle").alias("sync_status"), (F.col("user_id") % 50).alias("completed"),
        (F.col("event_id") % 7 * 10).alias("total"), F.col("ts").cast("timestamp").alias("started_at"), F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + F.col("event_id") % 600 - 100).alias("now"),
    )
    return stats.progress(rows).select("event_id", "percent", "stale")


def shown_sizes(spark, sf):
    then, now = F.timestamp_seconds(F.lit(1_000_000)), F.timestamp_seconds(F.lit(1_000_000) + F.col("p_partkey") * 97)
    return table(spark, sf, "part").select("p_partkey", stats.age_text(then, now).alias("age"), stats.short_age(then, now).alias("short_age"))


def _old(spark, sf):
    rows = doc_files(spark, sf).where("doc_id % 5 <> 0")
    return rows.select("doc_id", "file_path", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("content", F.lit("!")))).otherwise(F.md5("content")).alias("file_hash"))


def _new(spark, sf):
    return doc_files(spark, sf).where("doc_id % 11 <> 0").select("doc_id", "file_path", F.md5("content").alias("file_hash"))


def diff_files(spark, sf):
    return S.changes(_new(spark, sf), _old(spark, sf))


def gc_orphans(spark, sf):
    return N.drop_files(line_chunks(spark, sf).select("file_path", "chunk_index"), _old(spark, sf).join(_new(spark, sf), "file_path", "left_anti"))


def upsert_chunks(spark, sf):
    rows = line_chunks(spark, sf)
    old = rows.where("doc_id % 2 = 0").select("file_path", "chunk_index", "file_hash", F.lit("old").alias("version"))
    new = rows.where("doc_id % 3 = 0").select("file_path", "chunk_index", F.md5(F.concat("chunk_text", F.lit("!"))).alias("file_hash"), F.lit("new").alias("version"))
    return N.upsert(old, new)


def orphan_chunks(spark, sf):
    last = doc_files(spark, sf).where("doc_id % 2 = 0").select("file_path", (F.col("doc_id") % 6).alias("max_index"))
    return N.drop_orphans(line_chunks(spark, sf).select("file_path", "chunk_index"), last)


def embedded_documents(spark, sf):
    rows = embed_column(doc_files(spark, sf).select("doc_id", "content"), HashEmbedder(16), "content")
    return rows.select("doc_id", F.size("embedding").alias("dimensions"))


def stream_upsert(spark, sf):
    """The newest event of each user, from a stream over the table's files."""
    from lodestone.streaming.sync import upsert_latest

    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").option("recursiveFileLookup", True).parquet(sf)
    out = fresh_dir(spark, "stream-out")
    query = upsert_latest(events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", out, fresh_dir(spark, "stream-state"))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{out}/{query.lastProgress['batchId']}")


# Predicates -----------------------------------------------------------------

INCLUDE, EXCLUDE = V.DEFAULTS["indexing"]["include"], V.DEFAULTS["indexing"]["exclude"]


def eligible_files(spark, sf):
    ok = globs.eligible(F.col("file_path"), F.col("size"), INCLUDE, EXCLUDE, ["docs/**"])
    return paths(spark).select("file_path", ok.alias("eligible"))


def acl_filter(spark, sf):
    rows = spark.createDataFrame(DIRECTORIES, "path string, allow array<string>, deny array<string>")
    return rows.select("path", globs.denied(F.col("path"), F.col("allow"), F.col("deny"), "/home/ann").alias("denied"))


def route_query(spark, sf):
    rows = spark.createDataFrame(REQUESTS, "id int, pattern string, path string, output_mode string, from_shell boolean")
    return route.route(rows, INCLUDE, EXCLUDE).select("id", "route")


def shell_pattern(spark, sf):
    rows = spark.createDataFrame(COMMANDS, "id int, command string")
    return route.shell_search(rows).select("id", "pattern", "path")


def shown_hits(spark, sf):
    chunks = doc_chunks(spark, sf)
    hits = fulltext.lexical_search(chunks, doc_index(spark, sf), text_queries(spark), 5).join(chunks.select("chunk_id", "chunk_text"), "chunk_id")
    return stats.hit_rows(hits, V.CODE_PREVIEW, "…")


ALL = (
    knn_topk, knn_threshold, knn_prefix_compat, knn_prefix_exact, knn_multi_query, bm25_or, bm25_and, bm25_tiered, bm25_prefix, bm25_porter, bm25_phrase,
    lexical_search, rrf_fusion, hybrid_search, hybrid_debug, hybrid_graph, merged_hits, identifier_split, fts_query_compile, identifier_boost,
    file_type_multiplier, synonym_expand, language_of, strip_noise, extract_definitions, extract_references, find_symbol, find_references, outline,
    path_fragment, files_defining, ext_grid, file_graph_raw, file_graph_binary, file_graph_sqrt, file_graph_max_definers, ppr, graph_expand, chunk_fixed, chunk_syntax,
    chunk_hybrid, preamble_claim, index_stats, file_stats, ext_counts, mean_chunks, coverage, health, sync_progress, shown_sizes, diff_files,
    gc_orphans, upsert_chunks, orphan_chunks, embedded_documents, stream_upsert, eligible_files, acl_filter, route_query, shell_pattern, shown_hits,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
