"""Corpus pipeline: quality, site lines, near copies, mix, tokens; each stage's result is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, lines, mixing, near_dups, quality
from lodestone.llm.common import table
from lodestone.plans.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays from this probability of label 1 on.
QUALITY = 0.3
TOKENIZER = "word_bpe_49k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to their labels, does not reject.

    Every row is scored by itself: null and empty texts as an empty text, long ones
    whole, repeated rows and null ids too. Without labels the score is 0.5, so that all
    stay; an empty table gives none. Other columns than COLUMNS are left out.
    """
    docs = docs.select(COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= QUALITY).select(COLUMNS)


def without_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur on their site; n_chars is that of the new text.

    No row goes. Null texts stay null, with null n_chars; an empty text stays; a null
    source is a site; repeated rows are pages of their own; an empty table gives none.
    """
    return lines.drop_boilerplate(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id, null last, then the least digest of the text.

    Null texts count as empty, and empty ones as copies of each other; of repeated rows
    one stays, the same in every run; an empty table gives none.
    """
    return near_dups.drop_copies(docs.select(COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, in the order of its schedule.

    Rows without words (null and empty texts) are not taken; a null source is a source;
    rows of one id share what the id takes; an empty table gives none.
    """
    return mixing.blend(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix, a row a row; null and empty texts have no tokens."""
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", good_documents),
    ("site_lines", without_site_lines),
    ("near_copies", one_of_each_group),
    ("mix", mixed),
    ("tokens", tokens),
]

#: Not expressible: a trained classifier, sketches and byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents`` of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
