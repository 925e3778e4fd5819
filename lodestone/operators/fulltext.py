"""Full-text search: a stored index of positional postings, phrases, BM25, and the two tiers of a query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as V
from lodestone.functions import text as T
from lodestone.functions.stem import porter, stem_terms
from lodestone.plans.storage import small

FIELDS = ("file_path", "chunk_text", "identifiers")
POSTING = "term string, field int, chunk_id long, file_path string, n_terms int, positions array<int>"
#: Terms of queries that are named to the scan, which reads their row groups only; more are joined to all postings.
NAMED, NAMED_EACH = 10_000, 64


@dataclass(frozen=True)
class TextIndex:
    """Postings (POSTING, stemmed or not), and of how many chunks and terms."""

    postings: DataFrame
    chunks: int
    terms: int
    stem: bool = False

    @property
    def mean(self) -> float:
        return self.terms / self.chunks if self.chunks else 1.0


def compile_queries(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """queries (query_id, text) with ``all_phrases`` (null: no narrow tier) and ``any_phrases`` (null: nothing to look for)."""
    return queries.withColumn("all_phrases", T.query_all(F.col(text))).withColumn("any_phrases", T.query_any(F.col(text)))


def phrases(compiled: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, phrase, narrow, tiered, words, at, term): a row a term of each phrase of the queries."""
    tiered = F.col("all_phrases").isNotNull()
    rows = compiled.where("any_phrases is not null").select(
        "query_id", tiered.alias("tiered"), F.coalesce("all_phrases", F.array().cast("array<string>")).alias("narrow_of"), F.explode("any_phrases").alias("phrase")
    )
    rows = rows.withColumn("narrow", F.expr("array_contains(narrow_of, phrase)")).withColumn("terms", T.index_terms(F.col("phrase")))
    rows = rows.select("query_id", "phrase", "narrow", "tiered", F.size("terms").alias("words"), F.posexplode("terms").alias("at", "term"))
    return stem_terms(rows) if stem else rows


def n_terms(fields=FIELDS) -> Column:
    """Terms of a chunk over all its fields."""
    return sum((F.size(T.index_terms(F.coalesce(F.col(f), F.lit("")))) for f in fields), F.lit(0)).cast("int")


def postings(chunks: DataFrame, fields=FIELDS, stem: bool = False) -> DataFrame:
    """POSTING of the text fields of chunks: a row a term of each field, with its places in it. Chunks are tokenized here, when they are indexed."""
    parts = [F.struct(F.lit(i).alias("field"), T.index_terms(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for i, f in enumerate(fields)]
    rows = chunks.select("chunk_id", "file_path", F.array(*parts).alias("parts"))
    total = F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["terms"]))
    rows = rows.select("chunk_id", "file_path", total.alias("n_terms"), F.explode("parts").alias("p")).select("chunk_id", "file_path", "n_terms", "p.field", "p.terms")
    return rows.mapInArrow(_places(stem), POSTING)


def _places(stem: bool, rows: int = 65_536):
    """Arrow batches of (chunk_id, file_path, n_terms, field, terms) to POSTING: a field's places are in one row already, so they are gathered without a shuffle."""

    def task(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            lists = batch.column("terms")
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            names, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if stem:
                stems = pa.array([porter(t) for t in names.to_pylist()], pa.string()).dictionary_encode()
                names, codes = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            place = np.arange(len(codes)) - np.repeat(sizes.cumsum() - sizes, sizes)
            key = np.repeat(np.arange(len(sizes)), sizes) * len(names) + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            owner, term = np.divmod(key[first], len(names))
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
            fields = [batch.column(c).take(pa.array(owner)) for c in ("field", "chunk_id", "file_path", "n_terms")]
            out = pa.RecordBatch.from_arrays([names.take(pa.array(term)), *fields, positions], ["term", "field", "chunk_id", "file_path", "n_terms", "positions"])
            for at in range(0, out.num_rows, rows):
                yield out.slice(at, rows)

    return task


def by_term(rows: DataFrame) -> DataFrame:
    """Postings as they are stored: in ranges of the term (a common term in several, by chunk), sorted, so that a scan for terms skips the other row groups."""
    return rows.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id", "field")


def write_index(chunks: DataFrame, path: str, fields=FIELDS, stem: bool = False) -> TextIndex:
    """Tokenize chunks once into postings at ``path``; a term has a place for each time it stands in a chunk."""
    by_term(postings(chunks, fields, stem)).write.parquet(f"{path}/postings")
    rows = chunks.sparkSession.read.schema(POSTING).parquet(f"{path}/postings")
    terms = rows.agg(F.coalesce(F.sum(F.size("positions").cast("long")), F.lit(0))).first()[0]
    return TextIndex(rows, chunks.count(), terms, stem)


def of_terms(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """The postings of the terms of phrases, with the phrases."""
    terms = [r[0] for r in wanted.select("term").distinct().limit(NAMED + 1).collect()]
    if len(terms) > NAMED:
        return index.postings.join(small(wanted), "term")
    rows = index.postings
    if len(terms) <= NAMED_EACH:  # each a comparison of its own, which row groups are held against
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("term") == t for t in terms], F.lit(False)))
    else:
        rows = rows.where(F.col("term").isin(terms))
    return rows.join(F.broadcast(wanted), "term")


def phrase_counts(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, phrase, narrow, tiered, chunk_id, file_path, n_terms, tf): occurrences of phrases, all terms in a row in one field."""
    met = of_terms(index, wanted)
    keys = ["query_id", "phrase", "narrow", "tiered", "chunk_id", "file_path", "n_terms"]
    single = met.where("words = 1").select(*keys, F.size("positions").cast("long").alias("n"))
    several = met.where("words > 1").select(*keys, "words", "field", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("start"))
    several = several.groupBy(*keys, "words", "field", "start").agg(F.count("*").alias("m")).where("m = words").select(*keys, F.lit(1).cast("long").alias("n"))
    return single.unionByName(several).groupBy(*keys).agg(F.sum("n").alias("tf"))


def bm25(index: TextIndex, queries: DataFrame, prefix: str | None = None, text: str = "query_text", tiers: str = "both") -> DataFrame:
    """(query_id, chunk_id, file_path, bm25, fts_rank) of the chunks that the queries match; lower is better.

    A query of three words or more keeps to the chunks with all of them, scored by those
    words alone, where there is one (below the path prefix, which is not case-sensitive);
    otherwise, and other queries, to those with any phrase. Counts of chunks and mean
    length are those of the whole index. tiers: both, or the one asked for. What is known
    of a phrase or a query (its chunks, whether it is narrowed) is summed where the
    matches are and joined back, so that a common word is nowhere gathered.
    """
    wanted = phrases(compile_queries(queries, text), index.stem)
    counts = phrase_counts(index, wanted)
    df = small(counts.groupBy("query_id", "phrase").agg(F.count("*").alias("df")))
    idf = F.log((index.chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(V.IDF_FLOOR)).otherwise(idf)
    norm = 1 - V.BM25_B + V.BM25_B * F.col("n_terms") / F.lit(float(index.mean))
    score = -idf * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + V.BM25_K1 * norm)
    per = counts.join(df, ["query_id", "phrase"]).withColumn("score", score).groupBy("query_id", "tiered", "chunk_id", "file_path").agg(
        F.sum("score").alias("any_score"), F.sum(F.when(F.col("narrow"), F.col("score"))).alias("all_score"), F.sum(F.col("narrow").cast("int")).alias("hits")
    )
    sizes = wanted.where("narrow").groupBy("query_id").agg(F.countDistinct("phrase").alias("need"))
    per = per.join(small(sizes), "query_id", "left").withColumn("whole", F.col("tiered") & F.coalesce(F.col("hits") == F.col("need"), F.lit(False)))
    if prefix:
        per = per.where(F.lower("file_path").startswith(prefix.lower()))
    if tiers == "both":
        narrowed = small(per.where("whole").select("query_id", F.lit(True).alias("narrowed")).distinct())
        per = per.join(narrowed, "query_id", "left").withColumn("narrowed", F.coalesce("narrowed", F.lit(False)))
    else:
        per = per.withColumn("narrowed", F.lit(tiers == "all"))
    per = per.where("whole or not narrowed").select("query_id", "chunk_id", "file_path", F.when(F.col("narrowed"), F.col("all_score")).otherwise(F.col("any_score")).alias("bm25"))
    return per.withColumn("fts_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.round("bm25", 9), "chunk_id")))


def normalized(scores: DataFrame, column: str = "bm25") -> DataFrame:
    """scores with ``bm25_norm``: 1 for a query's best, 0 for its worst, 1 for all if they are equal."""
    w = W.partitionBy("query_id")
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return scores.withColumn("bm25_norm", F.when(lo == hi, F.lit(1.0)).otherwise((hi - F.col(column)) / (hi - lo)))


def lexical_search(chunks: DataFrame, index: TextIndex, queries: DataFrame, k: int = 10, prefix: str | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, file_path, start_line, end_line, similarity, score): full text alone, 2k candidates, weighed by kind of file and identifiers."""
    found = normalized(bm25(index, queries, prefix).where(F.col("fts_rank") <= 2 * k)).drop("file_path")
    rows = chunks.join(small(found), "chunk_id").join(small(queries.select("query_id", "query_text")), "query_id")
    score = F.col("bm25_norm") * T.file_multiplier(F.col("file_path")) * T.identifier_boost(F.col("query_text"), F.col("chunk_text"))
    rows = rows.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "fts_rank")))
    return rows.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "file_path", "start_line", "end_line", F.lit(0.0).alias("similarity"), "score")
