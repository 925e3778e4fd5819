"""The stored index: segments of immutable Parquet tables, and numbered state files of which the greatest counts."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fulltext
from lodestone.plans.storage import drop_shared, small

VERSION = 4
SCHEMAS = {
    "chunks": "chunk_id long, file_path string, chunk_index int, chunk_text string, start_line int, end_line int, embedding array<float>, file_hash string, updated_at timestamp, identifiers string, n_terms int",
    "symbols": "file_path string, name string, kind string, line int",
    "refs": "file_path string, name string",
    "files": "file_path string, file_hash string, size long, mtime timestamp",
    "postings": fulltext.POSTING,
}
#: Tables sorted within files by the column that lookups filter by.
SORTED = {"chunks": ["file_path", "chunk_index"], "symbols": ["name", "file_path"], "refs": ["name", "file_path"], "files": ["file_path"]}
GONE = "file_path string, seq long"
#: Segments of an index before they are merged; state files that stay.
MOST_SEGMENTS, KEPT_STATES = 16, 3


class Damaged(ValueError):
    """No state of the index can be read."""


class Snapshots:
    """An index below a folder; readers keep what they have while it is changed.

    A change is a segment: the rows of new and changed files, and the paths of files
    whose older rows no longer count. It is there once a state file names it. State
    files are numbered and written whole before they get their name, so that a crash
    leaves the one before; a number is given once, so that of two writers one fails.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # State

    def _numbers(self) -> list[int]:
        """Numbers of the state files, the greatest first."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(self._path(""))]
        return sorted((int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json") and n[6:-5].isdigit()), reverse=True)

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def state(self) -> dict:
        """Key-value state of the index: the newest file that can be read, empty for none; Damaged if none of several can be."""
        numbers = self._numbers()
        for n in numbers:
            try:
                found = json.loads(self._read(f"state-{n:012d}.json"))
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
        if numbers:
            raise Damaged(f"no state of {self.folder} can be read")
        return {}

    def _replace(self, state: dict) -> None:
        fs, numbers = self._fs(), self._numbers()
        draft, new = self._path(f".draft-{uuid.uuid4().hex}"), self._path(f"state-{(numbers[0] if numbers else 0) + 1:012d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(new) or not fs.rename(draft, new):
            fs.delete(draft, False)
            raise OSError(f"{new} is there already: another writer was faster")
        for n in numbers[KEPT_STATES - 1 :]:
            fs.delete(self._path(f"state-{n:012d}.json"), False)

    def set_state(self, **values) -> None:
        self._replace({**self.state(), **values})

    def clear_state(self, prefix: str) -> None:
        self._replace({k: v for k, v in self.state().items() if not k.startswith(prefix)})

    # Tables

    def table(self, name: str) -> DataFrame:
        """The rows of a table that count, none before the first change. Folders of one version of all tables, as older releases wrote them, are read too."""
        state = self.state()
        if "segments" not in state:
            return self._older(name, state)
        segments = state["segments"]
        if not segments:
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.schema(f"{SCHEMAS[name]}, seq long").parquet(*[f"{self.folder}/{s}/{name}" for s in segments])
        if len(segments) > 1:
            gone = self.spark.read.schema(GONE).parquet(*[f"{self.folder}/{s}/gone" for s in segments[1:]])
            gone = gone.groupBy("file_path").agg(F.max("seq").alias("until"))
            rows = rows.join(small(gone), "file_path", "left").where("until is null or seq >= until")
        return rows.select(*_columns(name))

    def _older(self, name: str, state: dict) -> DataFrame:
        version, empty = state.get("schema_version", VERSION), self.spark.createDataFrame([], SCHEMAS[name])
        if "snapshot" not in state or name in ("symbols", "refs") and version < 3:
            return empty
        rows = self.spark.read.parquet(f"{self.folder}/{state['snapshot']}/{'chunks' if name in ('files', 'postings') else name}")
        if name in ("symbols", "refs"):
            return rows
        if version < 2:
            rows = rows.withColumn("identifiers", T.identifiers(F.col("chunk_text")))
        if name == "files":
            return rows.select("file_path", "file_hash", F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime")).distinct()
        return fulltext.postings(rows, stem=True) if name == "postings" else rows.withColumn("n_terms", fulltext.n_terms()).select(*_columns("chunks"))

    def text_index(self) -> fulltext.TextIndex:
        """The stored full text; its counts of chunks and terms are part of the state."""
        state = self.state()
        if "segments" in state:
            n = state["text_chunks"], state["text_terms"]
        else:
            n = _sums(self.table("chunks"))
        return fulltext.TextIndex(self.table("postings"), *n, stem=True)

    def append(self, gone: DataFrame | None = None, values: dict | None = None, **tables: DataFrame) -> None:
        """Add a segment: rows of the tables given, in place of all rows of the files ``gone`` (file_path) and of the files of these rows.

        values: state to set with it. Only the segment is written; the index is merged
        into one segment when it has many.
        """
        state = self.state()
        if "segments" not in state and "snapshot" in state:
            self.compact()
            state = self.state()
        seq = state.get("seq", 0) + 1
        name = f"{seq:08d}-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        for table, kind in SCHEMAS.items():
            _write(tables.get(table, self.spark.createDataFrame([], kind)), table, seq, f"{path}/{table}")
        written = self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{path}/chunks")
        files = self.spark.read.schema(SCHEMAS["files"]).parquet(f"{path}/files").select("file_path")
        gone = (files if gone is None else gone.select("file_path").union(files)).distinct()
        gone.select("file_path", F.lit(seq).cast("long").alias("seq")).coalesce(1).write.parquet(f"{path}/gone")
        new, lost = _sums(written), (0, 0)
        if state.get("segments"):
            gone = self.spark.read.schema(GONE).parquet(f"{path}/gone").select("file_path")
            lost = _sums(self.table("chunks").join(small(gone), "file_path", "left_semi"))
        sums = {k: state.get(k, 0) + a - b for k, a, b in zip(("text_chunks", "text_terms"), new, lost, strict=True)}
        self._replace({**self.state(), **(values or {}), **sums, "seq": seq, "segments": [*state.get("segments", []), name], "schema_version": VERSION})
        if len(state.get("segments", [])) >= MOST_SEGMENTS:
            self.compact()
        self.prune()

    def compact(self) -> None:
        """Merge the segments: each table's rows that count are written once."""
        state = self.state()
        seq = state.get("seq", 0) + 1
        name = f"{seq:08d}-{uuid.uuid4().hex}"
        for table in SCHEMAS:
            _write(self.table(table), table, seq, f"{self.folder}/{name}/{table}")
        self.spark.createDataFrame([], GONE).write.parquet(f"{self.folder}/{name}/gone")
        n = _sums(self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{self.folder}/{name}/chunks"))
        self._replace({**self.state(), "seq": seq, "segments": [name], "text_chunks": n[0], "text_terms": n[1], "schema_version": VERSION})

    def prune(self) -> None:
        """Remove segments that no state file names. Readers of the state before keep theirs."""
        fs, named = self._fs(), set()
        for n in self._numbers():
            try:
                state = json.loads(self._read(f"state-{n:012d}.json"))
            except ValueError:
                continue
            named |= {*state.get("segments", []), state.get("snapshot")}
        for f in fs.listStatus(self._path("")):
            name = f.getPath().getName()
            if f.isDirectory() and name not in named:
                drop_shared(self.spark, f"{self.folder}/{name}")

    def readable(self) -> bool:
        """Whether the state and the footers of all tables' files can be read."""
        try:
            for s in self.state().get("segments", []):
                for table in SCHEMAS:
                    self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/{s}/{table}").schema  # noqa: B018
        except (Damaged, PySparkException):
            return False
        except Exception as e:  # what the JVM says of a file that is cut short
            if type(e).__module__.startswith("py4j"):
                return False
            raise
        return True

    def size_bytes(self) -> int:
        return sum(self._fs().getContentSummary(self._path(s)).getLength() for s in self.state().get("segments", []))

    def delete_all(self) -> None:
        drop_shared(self.spark, self.folder)


def _columns(table: str) -> list[str]:
    return [x.split()[0] for x in SCHEMAS[table].split(", ")]


def _write(rows: DataFrame, table: str, seq: int, path: str) -> None:
    rows = rows.select(*_columns(table))
    rows = fulltext.by_term(rows) if table == "postings" else rows.sortWithinPartitions(*SORTED[table])
    rows.withColumn("seq", F.lit(seq).cast("long")).write.parquet(path)


def _sums(chunks: DataFrame) -> tuple[int, int]:
    return tuple(chunks.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first())


def chunk_id(path=None, index=None):
    return F.xxhash64(path if path is not None else F.col("file_path"), index if index is not None else F.col("chunk_index"))


def upsert(old: DataFrame, new: DataFrame, keys=("file_path", "chunk_index")) -> DataFrame:
    """old with rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def drop_files(old: DataFrame, files: DataFrame) -> DataFrame:
    return old.join(files.select("file_path").distinct(), "file_path", "left_anti")


def drop_orphans(chunks: DataFrame, last: DataFrame) -> DataFrame:
    """chunks without those above their file's last index (file_path, max_index)."""
    rows = chunks.join(last, "file_path", "left").where("max_index is null or chunk_index <= max_index")
    return rows.drop("max_index")
