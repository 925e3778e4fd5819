"""Chunks of files: at declarations, of fixed size, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as V
from lodestone.functions import text as T

CHUNK = "array<struct<start:int,end:int>>"


def fixed_ranges(lines: Column, max_chars: int, overlap_chars: int) -> Column:
    """Line ranges (1-based, inclusive) of chunks of ``max_chars`` that repeat about ``overlap_chars``.

    P(i) being the characters of the first i lines with their ends: a chunk from line s
    ends at the first line after the last chunk's end with P(e) - P(s - 1) >= max, and
    the next starts at the last line j with P(e) - P(j - 1) >= overlap, at s at least.
    What is left is the last chunk, even if it is overlap only. One fold over the lines.
    """
    kind = "struct<start:int,size:int,at:int,kept:array<int>,ranges:array<struct<start:int,end:int>>>"
    zero = F.from_json(F.lit('{"start":1,"size":0,"at":0,"kept":[],"ranges":[]}'), kind)
    sizes = F.transform(lines, lambda x: F.length(x) + 1)

    def step(acc: Column, size: Column) -> Column:
        at, total = acc["at"] + 1, acc["size"] + size
        full = total >= max_chars
        kept = F.concat(acc["kept"], F.array(size))
        # Sizes of the shortest tail of the chunk that reaches the overlap, or all of it.
        back = F.transform(F.sequence(F.lit(1), F.size(kept)), lambda n: F.aggregate(F.slice(kept, -n, n), F.lit(0), lambda a, b: a + b))
        need = F.coalesce(F.get(F.filter(F.sequence(F.lit(1), F.size(kept)), lambda n: F.get(back, n - 1) >= overlap_chars), F.lit(0)), F.size(kept))
        tail = F.when(F.lit(overlap_chars <= 0), F.array().cast("array<int>")).otherwise(F.slice(kept, -need, need))
        tail_size = F.aggregate(tail, F.lit(0), lambda a, b: a + b)
        return F.struct(
            F.when(full, F.greatest(F.lit(1), at - F.size(tail) + 1)).otherwise(acc["start"]).cast("int").alias("start"),
            F.when(full, tail_size).otherwise(total).cast("int").alias("size"),
            at.cast("int").alias("at"),
            F.when(full, tail).otherwise(kept).alias("kept"),
            F.when(full, F.concat(acc["ranges"], F.array(F.struct(acc["start"].alias("start"), at.cast("int").alias("end"))))).otherwise(acc["ranges"]).alias("ranges"),
        )

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["start"].alias("start"), acc["at"].alias("end")))
        return F.when(F.size(acc["kept"]) > 0, F.concat(acc["ranges"], rest)).otherwise(acc["ranges"]).cast(CHUNK)

    return F.aggregate(sizes, zero, step, finish)


def _cut(rows: DataFrame, ranges: Column) -> DataFrame:
    """(file_path, chunk_index, chunk_text, start_line, end_line) of rows with ``lines`` and ranges."""
    rows = rows.select("file_path", "lines", F.posexplode(ranges).alias("chunk_index", "r"))
    text = F.array_join(F.slice("lines", F.col("r.start"), F.col("r.end") - F.col("r.start") + 1), "\n")
    return rows.select("file_path", "chunk_index", text.alias("chunk_text"), F.col("r.start").alias("start_line"), F.col("r.end").alias("end_line"))


def fixed_chunks(files: DataFrame, max_tokens: int = 512, overlap_tokens: int = 50) -> DataFrame:
    """Fixed-size chunks of files (file_path, content). An empty file is one empty chunk."""
    rows = files.select("file_path", F.split(F.col("content"), "\n").alias("lines"))
    return _cut(rows, fixed_ranges(F.col("lines"), max_tokens * V.CHARS_PER_TOKEN, overlap_tokens * V.CHARS_PER_TOKEN))


def is_boundary(path: Column, line: Column) -> Column:
    """Whether a chunk begins at the line, by the file's extension; false for other extensions."""
    ext, out = T.extension(path), F.lit(False)
    for e, pattern in V.BOUNDARIES.items():
        out = F.when(ext == e, line.rlike(pattern)).otherwise(out)
    return out


def preamble_starts(lines: DataFrame) -> DataFrame:
    """lines (file_path, n from 1, line) with ``boundary`` and ``start``: where the comments above the line begin.

    A line stops the walk up unless it is a comment, or blank below a comment; so the
    comments begin after the last stop before the line.
    """
    order = W.partitionBy("file_path").orderBy("n")
    comment = F.col("line").rlike(V.COMMENT_LINE)
    blank = T.trim_all(F.col("line")) == ""
    above = F.coalesce(F.lag(comment).over(order), F.lit(False))
    rows = lines.withColumn("boundary", is_boundary(F.col("file_path"), F.col("line"))).withColumn("stop", ~comment & ~(blank & above))
    last = F.last(F.when(F.col("stop"), F.col("n")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("start", F.when(F.col("boundary"), F.coalesce(last, F.lit(0)) + 1))


def syntax_ranges(files: DataFrame) -> DataFrame:
    """(file_path, lines, ranges): chunks at declarations, each with the comments above; none below two declarations.

    What comes before the first is a chunk unless it is blank; of declarations with the
    same start the earlier one's chunk is empty and left out.
    """
    rows = files.select("file_path", F.split(F.col("content"), "\n").alias("lines"))
    lines = rows.select("file_path", F.posexplode("lines").alias("i", "line")).select("file_path", (F.col("i") + 1).alias("n"), "line")
    starts = preamble_starts(lines).where("boundary").groupBy("file_path").agg(F.array_sort(F.collect_list("start")).alias("s"))
    rows = rows.join(starts.where(F.size("s") >= 2), "file_path")
    n = F.size("lines")
    body = F.transform("s", lambda a, i: F.struct(a.cast("int").alias("start"), F.coalesce(F.get("s", i + 1) - 1, n).cast("int").alias("end")))
    first = F.get("s", F.lit(0))
    head = F.when(
        (first > 1) & F.exists(F.slice("lines", F.lit(1), first - 1), lambda x: T.trim_all(x) != ""),
        F.array(F.struct(F.lit(1).alias("start"), (first - 1).cast("int").alias("end"))),
    ).otherwise(F.array().cast(CHUNK))
    return rows.select("file_path", "lines", F.concat(head, F.filter(body, lambda r: r["end"] >= r["start"])).alias("ranges"))


def chunks(files: DataFrame, strategy: str = "hybrid", max_tokens: int = 512, overlap_tokens: int = 50) -> DataFrame:
    """Chunks of files by strategy: fixed; syntax, fixed where it finds none; hybrid, also dividing syntax chunks above the size."""
    if strategy == "fixed":
        return fixed_chunks(files, max_tokens, overlap_tokens)
    most, overlap = max_tokens * V.CHARS_PER_TOKEN, overlap_tokens * V.CHARS_PER_TOKEN
    found = syntax_ranges(files)
    rest = fixed_chunks(files.join(found.select("file_path"), "file_path", "left_anti"), max_tokens, overlap_tokens)
    if strategy == "syntax":
        return _cut(found, F.col("ranges")).unionByName(rest)

    def divide(r: Column) -> Column:
        own = F.slice("lines", r["start"], r["end"] - r["start"] + 1)
        parts = F.transform(fixed_ranges(own, most, overlap), lambda p: F.struct(
            (r["start"] + p["start"] - 1).cast("int").alias("start"), (r["start"] + p["end"] - 1).cast("int").alias("end")))
        return F.when(F.length(F.array_join(own, "\n")) <= most, F.array(r)).otherwise(parts)

    return _cut(found, F.flatten(F.transform("ranges", divide))).unionByName(rest)
