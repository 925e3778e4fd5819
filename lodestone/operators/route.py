"""Routing of search requests: literal search, symbol lookup, or search by meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed as V
from lodestone.functions import text as T
from lodestone.functions.globs import matches_any


def shell_search(commands: DataFrame, column: str = "command") -> DataFrame:
    """commands with ``pattern`` and ``path`` of a search at the start of a pipeline; null for other commands, counts and listings."""
    args = F.regexp_extract(F.col(column), V.SHELL_SEARCH, 1)
    tokens = F.filter(F.regexp_extract_all(args, F.lit(f"({V.SHELL_TOKEN})"), F.lit(1)), lambda t: ~t.startswith("-"))
    words = F.transform(tokens, lambda t: F.regexp_replace(t, "^[\"']|[\"']$", ""))
    found = F.when(F.col(column).rlike(V.SHELL_SEARCH) & ~args.rlike(V.SHELL_COUNTS), words)
    return commands.withColumn("pattern", F.get(found, F.lit(0))).withColumn("path", F.when(F.get(found, F.lit(0)).isNotNull(), F.coalesce(F.get(found, F.lit(1)), F.lit(""))))


def out_of_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a search path is nothing that an index covers."""
    target = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "/+$", "")
    first = F.concat(F.substring_index(target, "/", 1), F.lit("/x"))
    excluded = matches_any(target, exclude) | matches_any(F.concat(target, F.lit("/x")), exclude) | matches_any(first, exclude)
    return (path != "") & (excluded | (target.rlike(r"\.[A-Za-z0-9]+$") & ~matches_any(target, include)))


def route(requests: DataFrame, include: list[str], exclude: list[str], min_length: int = 4, healthy: bool = True, mode: str = "redirect") -> DataFrame:
    """requests (pattern, path, output_mode, from_shell) with ``route``: pass, find_symbol or search_code.

    What stays with a literal search: short patterns, regular expressions, one file,
    counts, dotted names, paths, lines asked for outside a shell, quoted text, markers,
    addresses, places that the index does not cover, and all of it while the index is
    not healthy or routing is off.
    """
    p, path = F.col("pattern"), F.coalesce("path", F.lit(""))
    stays = (
        p.isNull() | (F.length(p) < min_length)
        | F.regexp_replace(p, r"\\\.", "").rlike(V.METACHARACTERS)
        | ((path != "") & ~path.endswith("/") & (T.extension(path) != ""))
        | (F.col("output_mode") == "count")
        | p.rlike(r"\w\.\w") | p.rlike(r"[/\\]")
        | (~F.col("from_shell") & (F.col("output_mode") == "content"))
        | p.rlike("^[\"']|[\"']$") | p.rlike(V.MARKER) | p.rlike(V.URL_LIKE)
        | out_of_scope(path, include, exclude)
    )
    if not healthy or mode == "off":
        stays = F.lit(True)
    return requests.withColumn("route", F.when(stays, "pass").when(p.rlike(r"^[A-Za-z_$][\w$]*$"), "find_symbol").otherwise("search_code"))
