"""Exact lookups: definitions, references, outlines, path fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """(file_path, kind, line) of the definitions of a name. A filter that parquet statistics prune by where files are sorted by name."""
    return symbols.where(F.col("name") == name).select("file_path", "kind", "line").orderBy("file_path", "line")


def find_references(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """(relation, file_path): files that define and files that refer to a name."""
    of = lambda rows, relation: rows.where(F.col("name") == name).select(F.lit(relation).alias("relation"), "file_path").distinct()
    return of(symbols, "defined_in").unionByName(of(refs, "referenced_by")).orderBy("relation", "file_path")


def outline(symbols: DataFrame, file_path: str) -> DataFrame:
    """(name, kind, line) of a file in line order."""
    return symbols.where(F.col("file_path") == file_path).select("name", "kind", "line").orderBy("line", "name")


def files_matching(symbols: DataFrame, fragment: str, limit: int = 20) -> DataFrame:
    """Files whose path contains a fragment, regardless of case."""
    return symbols.where(F.lower("file_path").contains(fragment.lower())).select("file_path").distinct().orderBy("file_path").limit(limit)


def files_defining(symbols: DataFrame, names: list[str]) -> DataFrame:
    """(file_path) of the files that define any of the names."""
    return symbols.where(F.col("name").isin(list(names))).select("file_path").distinct()


def has_symbols(symbols: DataFrame) -> bool:
    return not symbols.isEmpty()
