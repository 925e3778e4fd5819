"""Porter's stemmer (1980), applied to the distinct terms of an index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Step 2, 3 and 4 suffixes of the published algorithm, longest match first.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _suffix(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """Stem of a lower-case word; words of two letters or with other than a to z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    s = _suffix(word, ("sses", "ies", "ss", "s"))
    if s in ("sses", "ies"):
        word = word[:-2]
    elif s == "s":
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        s = _suffix(word, ("ed", "ing"))
        if s and _has_vowel(word[: -len(s)]):
            word = word[: -len(s)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        s = _suffix(word, table)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _suffix(word, STEP4)
    if s and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _cvc(word[:-1]):
            word = word[:-1]
    if _double(word) and word.endswith("l") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_terms(rows: DataFrame, column: str = "term") -> DataFrame:
    """rows with ``column`` stemmed; each distinct term is stemmed once, in Arrow batches."""

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            terms = batch.column(0)
            yield pa.RecordBatch.from_arrays([terms, pa.array([porter(t) for t in terms.to_pylist()], pa.string())], ["__term", "__stem"])

    terms = rows.select(F.col(column).alias("__term")).where("__term is not null").distinct().mapInArrow(task, "__term string, __stem string")
    return rows.join(terms, F.col(column) == F.col("__term"), "left").withColumn(column, F.col("__stem")).drop("__term", "__stem")
