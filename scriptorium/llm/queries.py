"""The queries of this folder's operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import flac, hpylm, license, mixing, quality, simhash, spiece, substring, tokencount, warc
from scriptorium.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("copies")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select("doc_id", *quality.BASE, "base_failed", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return license.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(flac.encode_texts(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """A public tokenizer's file; on the machines of a cluster the module that brings them is installed at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_flac": op2_flac,
    "op3_substring_dedup": op3_substring_dedup,
    "op6_simhash": op6_simhash,
    "op8_hpylm": op8_hpylm,
    "op9_token_counts": op9_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op7_license_scan": op7_license_scan,
}

SQL: dict[str, str] = {"op4_mixing": mixing.ORACLE}
