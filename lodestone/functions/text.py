"""Column functions over text: identifiers, query compilation, language, path and identifier weights."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import fixed as V


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in pairs.items() for x in kv])


def is_stop(word: Column) -> Column:
    return F.lower(word).isin(V.STOP_WORDS)


def is_camel(word: Column) -> Column:
    return word.rlike("[a-z][A-Z]")


def split_camel(word: Column) -> Column:
    """Parts of a camelCase or PascalCase word; HTTPServer gives HTTP and Server."""
    word = F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2")
    return F.split(F.regexp_replace(word, "([A-Z]+)([A-Z][a-z])", "$1 $2"), " ")


def split_snake(word: Column) -> Column:
    return F.filter(F.split(word, "_"), lambda p: p != "")


def none() -> Column:
    return F.array().cast("array<string>")


def identifiers(text: Column) -> Column:
    """The camelCase and snake_case identifiers of a text, each once and followed by its parts, joined by spaces."""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit("([a-zA-Z_$][a-zA-Z0-9_$]+)"), F.lit(1)))
    ids = F.filter(ids, lambda w: (is_camel(w) | w.contains("_")) & ~(is_stop(w) & (F.length(w) < 6)))
    parts = F.transform(ids, lambda w: F.concat(
        F.array(w), F.when(is_camel(w), split_camel(w)).otherwise(none()), F.when(w.contains("_"), split_snake(w)).otherwise(none()),
    ))
    return F.array_join(F.flatten(parts), " ")


def synonyms(word: Column) -> Column:
    """Words that a query with this one also looks for."""
    return F.coalesce(F.element_at(_map(V.SYNONYMS), F.lower(word)), none())


def query_tokens(query: Column) -> Column:
    """Words of a query (ASCII letters, digits, underscore) that are no stop words, repeated ones too."""
    return F.filter(F.split(F.regexp_replace(query, "[^A-Za-z0-9_]+", " "), " "), lambda t: (t != "") & ~is_stop(t))


def query_all(query: Column) -> Column:
    """Phrases that a match of the narrow tier has all of: three words at least, else there is no such tier (null)."""
    return F.when(F.size(query_tokens(query)) >= 3, F.array_distinct(query_tokens(query)))


def query_any(query: Column) -> Column:
    """Phrases of which a match has one: words, their parts and synonyms; null if there are none."""
    keep = lambda parts: F.filter(parts, lambda p: (F.length(p) > 1) & ~is_stop(p))
    each = F.transform(query_tokens(query), lambda t: F.concat(
        F.array(t), F.when(is_camel(t), keep(split_camel(t))).otherwise(none()),
        F.when(t.contains("_"), keep(split_snake(t))).otherwise(none()), synonyms(t),
    ))
    found = F.array_distinct(F.flatten(each))
    return F.when(F.size(found) > 0, found)


def extension(path: Column) -> Column:
    """Extension with its dot, of a base name that begins with none; else the empty string."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^.+?(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """Language family by extension, null for others."""
    return F.element_at(_map(V.LANGUAGES), F.regexp_extract(F.lower(path), r"(\.[a-z]+)$", 1))


def file_multiplier(path: Column) -> Column:
    """Weight of a result by kind of file; the first kind that fits counts."""
    path, m = F.lower(path), V.MULTIPLIERS
    return (
        F.when(path.rlike(r"(^|/)readme\.md$"), F.lit(m["readme"]))
        .when(path.endswith(".md"), F.lit(m["markdown"]))
        .when(path.rlike(V.TEST_FILE), F.lit(m["test"]))
        .when(path.rlike(V.CONFIG_FILE), F.lit(m["config"]))
        .otherwise(F.lit(1.0))
    )


def identifier_boost(query: Column, text: Column) -> Column:
    """Weight of a text that contains identifiers of the query, repeated ones counted again."""
    ids = F.regexp_extract_all(query, F.lit("([a-zA-Z_$][a-zA-Z0-9_$]{2,})"), F.lit(1))
    hits = F.size(F.filter(ids, lambda w: (is_camel(w) | w.contains("_")) & text.contains(w)))
    return F.least(F.lit(V.IDENTIFIER_CAP), 1.0 + V.IDENTIFIER_STEP * hits)


def rrf(vec_rank: Column, fts_rank: Column, k: int = V.RRF_K) -> Column:
    one = lambda r: F.coalesce(1.0 / (k + r), F.lit(0.0))
    return one(vec_rank) + one(fts_rank)


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Letters of one base letter and marks, and the base letters, up to Latin Extended Additional."""
    pairs = []
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(i):
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def index_terms(text: Column) -> Column:
    """Terms of a text: lower-case runs of letters and digits without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(text), *_folds()), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def trim_all(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def preview(text: Column, chars: int, ellipsis: str = "…") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(ellipsis))).otherwise(text)
