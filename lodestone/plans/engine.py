"""The engine: searches, lookups, status and maintenance over one stored index."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.functions import fixed as V
from lodestone.functions.globs import denied
from lodestone.operators import fusion, graph, lookup, stats
from lodestone.operators.fulltext import lexical_search
from lodestone.plans import indexing
from lodestone.sources.embedding import HttpEmbedder
from lodestone.sources.files import git_changed, listed, local, read_ignore, read_paths
from lodestone.sources.snapshot import Damaged, Snapshots

MODES = ("hybrid", "semantic", "lexical")
#: Rows of a lookup that come to the driver; what has more says so.
MOST_ROWS = 10_000


class Engine:
    """Queries over the index in ``folder`` of the source tree ``root``."""

    def __init__(self, spark: SparkSession, folder: str, root: str | None = None, config: dict | None = None, embedder=None, ignore_file: str = ".indexignore"):
        self.spark, self.root = spark, root
        self.config = C.load(config)
        self.store = Snapshots(spark, folder)
        self.embedder = embedder or HttpEmbedder(self.config["embedding"])
        self.ignore = read_ignore(spark, f"{root}/{ignore_file}") if root else []
        self._edges: dict = {}

    # Searches

    def _checked(self) -> None:
        stored = self.store.state().get("embedding_dimensions")
        if stored is not None and stored != self.embedder.dimensions:
            raise ValueError(f"the index has vectors of {stored} dimensions, the embedder gives {self.embedder.dimensions}")

    def _query_table(self, texts: list[str], with_vectors: bool) -> DataFrame:
        vectors = self.embedder.embed([self.config["embedding"]["query_prefix"] + t for t in texts]) if with_vectors else [None] * len(texts)
        return self.spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))], "query_id int, query_text string, vec array<double>")

    def edges(self):
        """The file graph, kept for the current state of the index: names where weights are raw, else edges."""
        h = self.config["search"]["hybrid"]
        key = tuple(self.store.state().get("segments", ())), h["graph_damping"], h["graph_max_definers"]
        if key not in self._edges:
            refs, symbols = self.store.table("refs"), self.store.table("symbols")
            made = graph.NameGraph(refs, symbols, key[2]) if key[1] == "raw" else graph.EdgeGraph(graph.file_graph(refs, symbols, *key[1:]))
            self._edges = {key: made}
        return self._edges[key]

    def search(self, texts: list[str], top_k: int | None = None, path: str | None = None, mode: str = "hybrid", threshold: float | None = None, prefix_mode: str = "compat") -> DataFrame:
        """Hits of each text with their chunk's text; by words alone where the embedder cannot be reached."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        s = self.config["search"]
        k = top_k or s["top_k"]
        if k < 0:
            raise ValueError("top_k must not be negative")
        threshold = s["similarity_threshold"] if threshold is None else threshold
        chunks = self.store.table("chunks")
        queries = None
        if mode != "lexical":
            self._checked()
            try:
                queries = self._query_table(texts, True)
            except (OSError, ValueError):
                mode = "lexical"
        if mode == "lexical":
            hits = lexical_search(chunks, self.store.text_index(), self._query_table(texts, False), k, path)
        elif mode == "semantic" or not s["hybrid"]["enabled"]:
            hits = fusion.vector_search(chunks, queries, k, threshold, path, prefix_mode)
        else:
            edges = self.edges() if s["hybrid"]["weight_graph"] > 0 and lookup.has_symbols(self.store.table("symbols")) else None
            hits = fusion.hybrid_search(chunks, self.store.text_index(), queries, edges, s["hybrid"], k, threshold, path, prefix_mode=prefix_mode)
        return hits.join(chunks.select("chunk_id", "chunk_text"), "chunk_id").orderBy("query_id", "rank")

    def search_code(self, query: str, top_k: int | None = None, path: str | None = None, mode: str = "hybrid") -> list[dict]:
        """Hits of one query as shown to a tool."""
        rows = stats.hit_rows(self.search([query], top_k, path, mode), V.CODE_PREVIEW, "…").orderBy("rank")
        return [r.asDict() for r in rows.drop("query_id", "rank").collect()]

    def search_merged(self, texts: list[str], **options) -> DataFrame:
        """Hits with adjacent ones of a file merged, the best first."""
        hits = self.search(texts, **options).withColumn("preview", F.substring("chunk_text", 1, V.CLI_PREVIEW))
        return fusion.merge_adjacent(hits).orderBy("query_id", F.desc(F.coalesce("score", "similarity")), "file_path", "start_line")

    def search_json(self, texts: list[str], **options) -> str:
        """One query: an array of matches; several: an array of {query, matches}."""
        rows = self.search_merged(texts, **options).collect()
        shown = lambda r: {
            "file": r.file_path, "lines": f"{r.start_line}-{r.end_line}", "similarity": f"{r.similarity:.3f}",
            **({"score": f"{r.score:.3f}"} if r.score is not None else {}), "preview": r.preview,
        }
        each = [{"query": t, "matches": [shown(r) for r in rows if r.query_id == i]} for i, t in enumerate(texts)]
        return json.dumps(each[0]["matches"] if len(texts) == 1 else each, ensure_ascii=False)

    # Lookups

    @staticmethod
    def _rows(df: DataFrame) -> tuple[list, dict]:
        """MOST_ROWS rows at most, and a note if there are more."""
        rows = df.limit(MOST_ROWS + 1).collect()
        return rows[:MOST_ROWS], {"truncated": True} if len(rows) > MOST_ROWS else {}

    def find_symbol(self, name: str) -> dict:
        rows, more = self._rows(lookup.find_symbol(self.store.table("symbols"), name))
        return {"found": bool(rows), "definitions": [{"file": r.file_path, "kind": r.kind, "line": r.line} for r in rows], **more}

    def find_references(self, name: str) -> dict:
        rows, more = self._rows(lookup.find_references(self.store.table("symbols"), self.store.table("refs"), name))
        of = lambda relation: [r.file_path for r in rows if r.relation == relation]
        return {"defined_in": of("defined_in"), "referenced_by": of("referenced_by"), "count": len(of("referenced_by")), **more}

    def outline(self, file: str) -> dict:
        """Symbols of a file by path, or by a fragment that one path has; else the paths that have it."""
        symbols = self.store.table("symbols")
        rows, more = self._rows(lookup.outline(symbols, file))
        if not rows:
            paths = [r.file_path for r in lookup.files_matching(symbols, file).collect()]
            if len(paths) != 1:
                return {"file": file, "candidates": paths, "symbols": []}
            file, (rows, more) = paths[0], self._rows(lookup.outline(symbols, paths[0]))
        return {"file": file, "symbols": [{"name": r.name, "kind": r.kind, "line": r.line} for r in rows], **more}

    def index_status(self) -> dict:
        try:
            state = self.store.state()
        except Damaged as e:
            return {"ok": False, "files": 0, "chunks": 0, "status": "damaged", "dimension_mismatch": False, "symbol_graph": False, "last_sync": None, "size_bytes": 0, "error": str(e)}
        chunks = self.store.table("chunks")
        row = stats.health(chunks, state.get("sync_status", "idle"), state.get("embedding_dimensions"), self.embedder.dimensions).first()
        return {**row.asDict(), "symbol_graph": lookup.has_symbols(self.store.table("symbols")), "last_sync": state.get("last_sync_time"), "size_bytes": self.store.size_bytes()}

    def report(self) -> dict:
        """The status with counts by extension, coverage and the files last indexed."""
        chunks = self.store.table("chunks")
        out = self.index_status() | {"mean_chunks": stats.mean_chunks(chunks).first()[0], "extensions": [r.asDict() for r in stats.extension_counts(chunks).limit(200).collect()]}
        if self.root:
            out["coverage"] = stats.coverage(chunks, self._files()).first().asDict()
        out["recent_files"] = [r.asDict() for r in stats.file_stats(chunks).limit(200).collect()]
        out["provider"] = C.detect_provider(self.config)
        return out

    # Maintenance

    def _files(self) -> DataFrame:
        """The files to index, without their contents."""
        return listed(self.spark, self.root, self.config, self.ignore)

    def changed_since(self, when: str) -> list[str] | None:
        """Paths that git says were committed since, or are modified or untracked now; None where git does not know the tree."""
        here = local(self.root)
        return None if here is None else git_changed(here, when)

    def allowed(self, allow: list[str], deny: list[str], home: str) -> bool:
        """Whether the lists let the root be indexed."""
        kind = "path string, allow array<string>, deny array<string>"
        real = lambda paths: [local(p) or p for p in paths]
        row = self.spark.createDataFrame([(*real([self.root]), real(allow), real(deny))], kind).select(denied(F.col("path"), F.col("allow"), F.col("deny"), home)).first()
        return not row[0]

    def recover(self, now: dt.datetime | None = None) -> None:
        """What a crash leaves: an index that cannot be read is removed, to be built anew; a run said to be in progress since more than 5 minutes, or from the future, is over."""
        if not self.store.readable():
            self.store.delete_all()
        state = self.store.state()
        if state.get("sync_status") == "in_progress":
            spent = ((now or dt.datetime.now(dt.UTC)) - dt.datetime.fromisoformat(state["sync_started_at"])).total_seconds()
            if spent > 300 or spent < 0:
                self.store.set_state(sync_status="idle")

    def sync(self, force: bool = False) -> dict:
        """Index what is new or changed and drop what is gone, a window of files at a time; what is committed stays on failure.

        The initial index is complete once a run has left no file behind.
        """
        began = dt.datetime.now(dt.UTC).isoformat()
        self.recover()
        stored = self.store.state().get("embedding_dimensions")
        if not force and stored is not None and stored != self.embedder.dimensions:
            self.store.set_state(sync_status="error", sync_error="embedding dimensions changed")
            return {"error": "embedding dimensions changed"}
        if not self.embedder.ping():
            self.store.set_state(sync_status="error", sync_error="the embedder cannot be reached")
            return {"error": "the embedder cannot be reached"}
        self.store.clear_state("sync_")
        self.store.set_state(sync_status="in_progress", sync_started_at=began)
        stopped = lambda: self.store.state().get("sync_cancel", "") >= began
        self.spark.sparkContext.setJobGroup(self._group(), "index", True)
        try:
            counts = indexing.sync(self.store, self._files(), self.root, self.config, self.embedder, force, stopped)
        except Exception as e:
            self.store.set_state(sync_status="error", sync_error=str(e)[:500])
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        whole = not counts.get("failed") and not counts.get("stopped")
        self.store.clear_state("sync_")
        self.store.set_state(sync_status="idle", last_sync_time=began, **({"initial_index_complete": True} if whole else {}), **({"sync_failed_files": counts["failed"]} if counts.get("failed") else {}))
        return counts

    def _group(self) -> str:
        return f"lodestone-sync-{self.store.folder}"

    def reindex(self) -> dict:
        self.store.delete_all()
        return self.sync()

    def update_file(self, file_path: str) -> None:
        """Bring one file into the index, reading it alone; drop it if it is no more."""
        from lodestone.functions.globs import eligible

        i = self.config["indexing"]
        rows = read_paths(self.spark, self.root, [file_path], i["max_file_size_kb"])
        found = rows.where(eligible(F.col("file_path"), F.col("size"), i["include"], i["exclude"], self.ignore, i["max_file_size_kb"]))
        if found.isEmpty():
            if rows.isEmpty():
                self.store.append(gone=self.spark.createDataFrame([(file_path,)], "file_path string"))
            return
        indexing.upsert_files(self.store, found, self.config, self.embedder)

    def gc(self) -> int:
        return indexing.collect_garbage(self.store, self._files())

    def cancel(self) -> dict:
        """End a running sync after its window, in whatever process it runs; its jobs at once where it is this session's."""
        if self.store.state().get("sync_status") != "in_progress":
            return {"status": "no_process"}
        self.store.set_state(sync_cancel=dt.datetime.now(dt.UTC).isoformat())
        self.spark.sparkContext.cancelJobGroup(self._group())
        return {"status": "cancelled"}
