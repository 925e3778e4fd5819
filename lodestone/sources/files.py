"""Files of a source tree as tables: from git where the tree is a repository, else by a walk."""

from __future__ import annotations

import datetime as dt
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed as V
from lodestone.functions.globs import eligible

LISTED = "file_path string, size long, mtime timestamp"


def local(root: str) -> str | None:
    """The real path of a root on this machine, None of another file system's."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return None if "://" in root else os.path.realpath(root)


def relative(path: Column, root: str) -> Column:
    """Path below the root, of a file URI or path."""
    root = (local(root) or root).rstrip("/") + "/"
    bare = F.regexp_replace(path, "^file:/*", "/")
    return F.when(bare.startswith(root), F.substring(bare, len(root) + 1, 1 << 20)).otherwise(bare)


def walked(path: Column) -> Column:
    """Whether a walk reaches a relative path: through no skipped and no dot directory."""
    dirs = "|".join(x.replace(".", r"\.") for x in V.SKIPPED_DIRS)
    return ~path.rlike(rf"(?:^|/)(?:{dirs})(?:/|$)") & ~path.rlike(r"(?:^|/)\.[^/]*/")


def git(root: str, *args: str) -> list[str] | None:
    """What a git command lists, in its order and each once; None without git or a repository."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=300)
    except (OSError, subprocess.SubprocessError):
        return None
    return list(dict.fromkeys(x for x in done.stdout.decode("utf-8", "surrogateescape").replace("\n", "\0").split("\0") if x))


def git_files(root: str) -> list[str] | None:
    """Tracked files, then untracked ones that are not ignored."""
    tracked, others = git(root, "ls-files", "-z"), git(root, "ls-files", "--others", "--exclude-standard", "-z")
    return None if tracked is None or others is None else list(dict.fromkeys(tracked + others))


def git_changed(root: str, since: str) -> list[str] | None:
    """Files of commits since a time, changed in the working tree or the index, or untracked; None outside a repository."""
    commits = git(root, "log", f"--since={since}", "--name-only", "-z", "--pretty=format:")
    others = git(root, "ls-files", "--others", "--exclude-standard", "-z")
    if commits is None or others is None:
        return None
    return list(dict.fromkeys(commits + (git(root, "diff", "--name-only", "-z", "HEAD") or []) + others))


def walk(root: str, max_files: int | None) -> list[str]:
    """Files below a local root by path, ``max_files`` at most: no links, no skipped and no dot directories."""
    found: list[str] = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in V.SKIPPED_DIRS and not d.startswith(".") and not os.path.islink(os.path.join(folder, d)))
        for name in sorted(names):
            path = os.path.join(folder, name)
            if name in V.SKIPPED_DIRS or os.path.islink(path) or not os.path.isfile(path):
                continue
            found.append(os.path.relpath(path, root))
            if max_files is not None and len(found) >= max_files:
                return found
    return found


def _stats(root: str, names: list[str]) -> list[tuple]:
    rows = []
    for name in names:
        path = os.path.join(root, name)
        if os.path.isfile(path) and not os.path.islink(path):
            s = os.stat(path)
            rows.append((name, s.st_size, dt.datetime.fromtimestamp(s.st_mtime_ns // 1_000_000 / 1000, dt.UTC)))
    return rows


def list_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """(file_path, size, mtime) of the tree, ``max_files`` at most. Contents are not read.

    A local tree is listed by git, without what git ignores, else by a walk; both leave
    out links. Trees of other file systems, which have no links, are listed by Spark.
    """
    if (here := local(root)) is not None:
        names = git_files(here)
        names = walk(here, max_files) if names is None else names[:max_files]
        return spark.createDataFrame(_stats(here, names), LISTED)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.select(relative(F.col("path"), root).alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows.where(walked(F.col("file_path"))).dropDuplicates(["file_path"])
    return rows if max_files is None else rows.orderBy("file_path").limit(max_files)


def listed(spark: SparkSession, root: str, config: dict, ignore: list[str] = ()) -> DataFrame:
    """list_files() of the files to index. The cap on files counts before the filter."""
    i = config["indexing"]
    rows = list_files(spark, root, i["max_files"])
    return rows.where(eligible(F.col("file_path"), F.col("size"), i["include"], i["exclude"], list(ignore), i["max_file_size_kb"]))


def read_paths(spark: SparkSession, root: str, names: list[str], max_kb: int) -> DataFrame:
    """(file_path, size, mtime, content, file_hash) of these files only; files that are gone or have grown beyond the limit give no row."""
    here = local(root)
    base = f"file://{here}" if here is not None else root.rstrip("/")
    if here is not None:
        names = [n for n in names if os.path.isfile(os.path.join(here, n))]
    else:
        path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        fs = path_of(base).getFileSystem(conf)
        names = [n for n in names if fs.exists(path_of(f"{base}/{n}"))]
    if not names:
        return spark.createDataFrame([], f"{LISTED}, content string, file_hash string")
    rows = spark.read.format("binaryFile").load([f"{base}/{_literal(n)}" for n in names])
    rows = rows.where(F.col("length") <= max_kb * 1024)
    rows = rows.select(relative(F.col("path"), root).alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("raw"))
    return rows.select("file_path", "size", "mtime", F.decode("raw", "UTF-8").alias("content"), F.sha2("raw", 256).alias("file_hash"))


def _literal(path: str) -> str:
    """A path without meaning for globs."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def read_ignore(spark: SparkSession, path: str) -> list[str]:
    """Globs of an ignore file: lines that are neither blank nor comments; none without the file."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).collect()
    except AnalysisException:
        return []
    return [x for x in (r.value.strip() for r in rows) if x and not x.startswith("#")]


def changes(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(file_path, change): added, changed, unchanged or deleted, by content hash."""
    c, i = current.select("file_path", F.col("file_hash").alias("now")), indexed.select("file_path", F.col("file_hash").alias("was")).distinct()
    rows = c.join(i, "file_path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return rows.select("file_path", change.alias("change"))


def suspects(present: DataFrame, known: DataFrame) -> DataFrame:
    """(file_path, suspect): of listed files those whose size or time is not the known one, which alone are read; ``gone`` of known ones no longer listed."""
    k = known.select("file_path", F.col("size").alias("was"), F.col("mtime").alias("at"))
    rows = present.join(k, "file_path", "full_outer")
    same = F.coalesce((F.col("size") == F.col("was")) & (F.col("mtime") == F.col("at")), F.lit(False))
    return rows.select("file_path", F.when(F.col("size").isNull(), "gone").when(same, "same").otherwise("read").alias("suspect"))
