"""Globs as regular expressions, and the predicates over paths built on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """Regular expression of a glob: ``*`` within a name, ``**`` any depth, no leading dot, ``{a,b}`` and ``[...]``."""
    dot = r"(?!\.)"
    out, depth, parts = "", 0, glob.split("/")
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += rf"(?:{dot}[^/]+(?:/{dot}[^/]+)*)?" if last else rf"(?:{dot}[^/]+/)*"
            continue
        i, name = 0, ""
        while i < len(part):
            c = part[i]
            if c == "*":
                while part[i + 1 : i + 2] == "*":
                    i += 1
                name += (dot if not name else "") + ("[^/]*" if len(part) > 1 else "[^/]+")
            elif c == "?":
                name += (dot if not name else "") + "[^/]"
            elif c == "[" and "]" in part[i + 1 :]:
                end = part.index("]", i + 1)
                body = part[i + 1 : end]
                name += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
                i = end
            elif c == "{":
                name, depth = name + "(?:", depth + 1
            elif c == "}" and depth:
                name, depth = name + ")", depth - 1
            elif c == "," and depth:
                name += "|"
            else:
                name += re.escape(c)
            i += 1
        out += name + ("" if last else "/")
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def eligible(path: Column, size: Column, include: list[str], exclude: list[str], ignore: list[str] = (), max_kb: int = 500) -> Column:
    """Whether a file is indexed: some include glob, no exclude or ignore glob, and small enough. No size: no file."""
    path = F.regexp_replace(path, r"\\", "/")
    return matches_any(path, list(include)) & ~matches_any(path, [*exclude, *ignore]) & F.coalesce(size <= max_kb * 1024, F.lit(False))


def under(path: Column, prefix: Column) -> Column:
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def ancestors(home: str) -> list[str]:
    """The root and each directory down to ``home``."""
    parts = [p for p in home.split("/") if p]
    return ["/", *("/" + "/".join(parts[: i + 1]) for i in range(len(parts)))]


def denied(path: Column, allow: Column, deny: Column, home: str) -> Column:
    """Whether a directory is not indexed: allowed trees come first; the ancestors of home are denied themselves, other denied directories with all below."""
    fixed = F.array(*map(F.lit, ancestors(home)))
    listed = F.exists(deny, lambda d: (path == d) | (~F.array_contains(fixed, d) & under(path, d)))
    return ~allowed(path, allow) & (F.array_contains(fixed, path) | listed)


def allowed(path: Column, allow: Column) -> Column:
    return F.exists(allow, lambda a: under(path, a))
