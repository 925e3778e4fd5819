"""Definitions and references of source files by patterns of their languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import fixed as V
from lodestone.functions import text as T


def strip_noise(text: Column) -> Column:
    """Text with comments and string literals blanked."""
    return reduce(lambda t, pr: F.regexp_replace(t, *pr), V.NOISE, text)


def _definition(language: Column, line: Column) -> Column:
    """struct(name, kind) of the first pattern of the language that gives a name; null for others."""
    bad = lambda n: n.isin(V.NOT_A_REFERENCE) | (F.length(n) < 2)
    out = F.lit(None).cast("struct<name:string,kind:string>")
    for lang, patterns in V.DEFINITIONS.items():
        tries = []
        for pattern, kind in patterns:
            name = F.regexp_extract(line, pattern, 1)
            tries.append(F.when((name != "") & ~bad(name), F.struct(name.alias("name"), F.lit(kind).alias("kind"))))
        out = F.when(language == lang, F.coalesce(*tries)).otherwise(out)
    return out


def definitions(files: DataFrame) -> DataFrame:
    """(file_path, name, kind, line) of files (file_path, content): one a line, each name and kind once a file."""
    lines = files.select("file_path", T.language(F.col("file_path")).alias("lang"), F.posexplode(F.split("content", "\n")).alias("i", "text"))
    bare = T.trim_all(F.col("text"))
    lines = lines.where(F.col("lang").isNotNull() & (bare != "") & ~bare.startswith("//") & ~bare.startswith("*"))
    found = lines.select("file_path", (F.col("i") + 1).alias("line"), _definition(F.col("lang"), F.col("text")).alias("d")).where("d is not null")
    first = W.partitionBy("file_path", "d.name", "d.kind").orderBy("line")
    return found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("file_path", "d.name", "d.kind", "line")


def reference_names(text: Column) -> Column:
    """Names that a text calls, constructs or imports, each once."""
    clean = strip_noise(text)
    all_of = lambda pattern: F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
    imported = F.flatten(F.transform(all_of(V.IMPORTED), lambda inner: F.transform(
        F.split(inner, ","), lambda p: T.trim_all(F.get(F.split(T.trim_all(p), r"\s+as\s+"), F.lit(0))))))
    named = F.concat(all_of(V.CALL), all_of(V.MEMBER_CALL), F.filter(imported, lambda n: F.length(n) > 2))
    return F.array_distinct(F.concat(F.filter(named, lambda n: ~n.isin(V.NOT_A_REFERENCE)), all_of(V.CONSTRUCTED)))


def references(files: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """(file_path, name) that files refer to and do not define themselves."""
    found = files.select("file_path", F.explode(reference_names(F.col("content"))).alias("name"))
    return found.join(defs.select("file_path", "name").distinct(), ["file_path", "name"], "left_anti") if defs is not None else found
