"""Indexing: files to chunks, symbols, references, postings and vectors, and the maintenance of the stored tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fulltext
from lodestone.operators.chunking import chunks as make_chunks
from lodestone.operators.symbols import definitions, references
from lodestone.plans.storage import Workspace, small
from lodestone.sources.embedding import embed_column
from lodestone.sources.files import read_paths, suspects
from lodestone.sources.snapshot import Snapshots, chunk_id

#: Files of a window, which is prepared, embedded and committed at once.
WINDOW = 2000


def prepare(files: DataFrame, config: dict, embedder, work: Workspace) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, failed): what files (file_path, content, file_hash, size, mtime) become, and the files (file_path) that could not be embedded.

    A batch of texts that the embedder refuses is tried again text by text; a file with
    a text that still fails is left out whole. Vectors are written once: they are the
    dear step, and a later failure must not repeat it.
    """
    c, e = config["chunking"], config["embedding"]
    files = work.keep(files.select("file_path", "content", "file_hash", "size", "mtime"), "index-files")
    rows = make_chunks(files.select("file_path", "content"), c["strategy"], c["max_tokens"], c["overlap_tokens"]).join(small(files.select("file_path", "file_hash")), "file_path")
    rows = rows.select(
        chunk_id().alias("chunk_id"), "file_path", "chunk_index", "chunk_text", "start_line", "end_line", "file_hash",
        F.current_timestamp().alias("updated_at"), T.identifiers(F.col("chunk_text")).alias("identifiers"),
    ).withColumn("n_terms", fulltext.n_terms())
    rows = work.keep(embed_column(rows, embedder, "chunk_text", e.get("document_prefix", ""), skip_failures=True), "index-chunks")
    failed = work.keep(rows.where("embedding is null").select("file_path").distinct(), "index-failed")
    kept = lambda df: df.join(small(failed), "file_path", "left_anti")
    good, rows = kept(files), kept(rows)
    defs = work.keep(definitions(good.select("file_path", "content")), "index-symbols")
    tables = {
        "chunks": rows, "symbols": defs, "refs": references(good.select("file_path", "content"), defs), "files": good.select("file_path", "file_hash", "size", "mtime"),
        "postings": fulltext.postings(rows, stem=True),
    }
    return tables, failed


def commit(store: Snapshots, files: DataFrame, config: dict, embedder, work: Workspace, values: dict | None = None) -> DataFrame:
    """Put files into the index in place of their older rows, in one segment; returns those (file_path) that could not be embedded."""
    tables, failed = prepare(files, config, embedder, work)
    store.append(values={"embedding_dimensions": embedder.dimensions, **(values or {})}, **tables)
    return failed


def _same(store: Snapshots, files: DataFrame) -> DataFrame:
    """files (file_path, file_hash) that the index has with the same content."""
    return store.table("files").select("file_path", "file_hash").join(small(files.select("file_path", "file_hash")), ["file_path", "file_hash"], "left_semi").select("file_path").distinct()


def sync(store: Snapshots, present: DataFrame, root: str, config: dict, embedder, force: bool = False, stopped: Callable[[], bool] = lambda: False, window: int | None = None) -> dict:
    """Bring the index to the listed files (file_path, size, mtime): new and changed ones are prepared, deleted ones dropped.

    Files of the size and time that the index knows are taken as unchanged and not
    read. The others go by windows of about ``window`` files, each read, compared by
    hash, embedded and committed by itself, so that an interrupted run loses its window
    only and the next one does what is left. Returns counts: added, changed, unchanged,
    deleted, failed. Between windows ``stopped`` is asked whether to end.
    """
    spark, window = store.spark, window or config["indexing"].get("window", WINDOW)
    counts: Counter = Counter()
    work = Workspace(spark)
    try:
        found = suspects(present, store.table("files"))
        if force:
            found = found.withColumn("suspect", F.when(F.col("suspect") == "same", "read").otherwise(F.col("suspect")))
        found = work.keep(found, "index-suspects")
        n = {r["suspect"]: r["count"] for r in found.groupBy("suspect").count().collect()}
        counts["unchanged"] += n.get("same", 0)
        if n.get("gone"):
            store.append(gone=found.where("suspect = 'gone'").select("file_path"))
            counts["deleted"] += n["gone"]
        todo = n.get("read", 0)
        windows = -(-todo // window)
        if todo:
            store.set_state(sync_total_files=todo, sync_completed_files=0, sync_failed_files=0)
        deal = F.pmod(F.xxhash64("file_path"), F.lit(max(1, windows)))
        known = store.table("files").select("file_path").distinct()
        known = work.keep(known.join(found.where("suspect = 'read'").select("file_path"), "file_path", "left_semi"), "index-known")
        for w in range(windows):
            if stopped():
                counts["stopped"] = 1
                break
            names = [r[0] for r in found.where((F.col("suspect") == "read") & (deal == w)).select("file_path").collect()]
            if not names:
                continue
            one = Workspace(spark)
            try:
                files = one.keep(read_paths(spark, root, names, config["indexing"]["max_file_size_kb"]), "index-read")
                same = one.keep(_same(store, files), "index-same")
                edited = files if force else files.join(small(same), "file_path", "left_anti")
                done = sum(counts.values()) - n.get("same", 0) - n.get("gone", 0) + len(names)
                failed = spark.createDataFrame([], "file_path string") if edited.isEmpty() else commit(store, edited, config, embedder, one, {"sync_completed_files": done})
                flag = lambda df, name: df.select("file_path", F.lit(True).alias(name)).distinct()
                rows = files.select("file_path").join(small(flag(failed, "failed")), "file_path", "left").join(small(flag(same, "same")), "file_path", "left").join(small(flag(known, "known")), "file_path", "left")
                kind = F.when(F.col("failed"), "failed").when(F.col("same"), "unchanged").when(F.col("known"), "changed").otherwise("added")
                counts.update({r["kind"]: r["count"] for r in rows.groupBy(kind.alias("kind")).count().collect()})
            finally:
                one.close()
        if counts["failed"]:
            store.set_state(sync_failed_files=counts["failed"])
    finally:
        work.close()
    return {k: v for k, v in counts.items() if v}


def upsert_files(store: Snapshots, files: DataFrame, config: dict, embedder) -> int:
    """Replace the rows of the given files whose content is new to the index; returns how many could not be embedded."""
    work = Workspace(store.spark)
    try:
        files = work.keep(files.select("file_path", "content", "file_hash", *[F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("mtime", "timestamp"))]), "index-given")
        edited = files.join(small(_same(store, files)), "file_path", "left_anti")
        return 0 if edited.isEmpty() else commit(store, edited, config, embedder, work).count()
    finally:
        work.close()


def collect_garbage(store: Snapshots, present: DataFrame) -> int:
    """Drop the rows of files that are no more among ``present`` (file_path); returns how many files."""
    work = Workspace(store.spark)
    try:
        gone = work.keep(store.table("files").select("file_path").distinct().join(present.select("file_path"), "file_path", "left_anti"), "index-gone")
        n = gone.count()
        if n:
            store.append(gone=gone)
        return n
    finally:
        work.close()
