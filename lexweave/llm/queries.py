"""Registered queries of this subpackage: one ``opN_<name>`` per operator, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bytebpe, htmltext, licenses, linededup, matroska, packing, quality, simhash, tokens, tokenstore, warc
from lexweave.llm.common import load


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(load(spark, sf_dir, "documents"))


def byte_ids():
    """Encoder of the packing query; a function, so that workers load their own."""
    return tokens.byte_encoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


def word_ids():
    """Encoder of the token-file query."""
    return tokens.word_encoder(tokenizer_path("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), byte_ids)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.spread_report(load(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(load(spark, sf_dir, "pages"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(load(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_files(load(spark, sf_dir, "documents"), word_ids)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_digest(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(load(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_media_columns": op2_media_columns,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_license_scans": op6_license_scans,
    "op7_token_files": op7_token_files,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_html_extraction": op9_html_extraction,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE: dict[str, str] = {"op1_quality_rules": quality.oracle(), "op4_line_dedup": linededup.oracle(), "op5_warc": warc.ORACLE}
