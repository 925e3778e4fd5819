"""The queries op1 to op10 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.spotsigs import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.near_dups import classes

    return classes(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("slots")


def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lines import digests

    return digests(table(spark, sf_dir, "documents"))


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.token_store import store

    return store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.topk import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix import digests

    return digests(table(spark, sf_dir, "documents"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import deduplicate

    return deduplicate(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_spotsigs, op2_quality, op3_order_minhash, op4_source_mix, op5_site_lines, op6_tree_bpe, op7_token_store, op8_exact_topk, op9_merged_transforms, op10_warc_revisits)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.oracles import SQL

    return dict(SQL)
