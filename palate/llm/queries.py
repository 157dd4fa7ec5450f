"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palate.llm import bpe, chat_repair, cover_codes, html_wrappers, license_scan, mixing, pii, quality_rules, token_align, warc_zstd
from palate.llm.common import documents
from palate.llm.embed_dedup import embed_dedup
from palate.llm.ngram_join import ngram_join
from palate.llm.pu_classifier import pu_classifier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


@query("op10_pu_classifier")
def op10_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


@query("op6_mixing", mixing.SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(documents(spark, sf_dir), tokenizer_path())


@query("op1_quality_rules", quality_rules.SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


@query("op8_embed_dedup")
def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op5_html_wrappers")
def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op2_license_scan", license_scan.SQL)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


@query("op3_chat_repair")
def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.chat_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op11_cover_codes", cover_codes.SQL)
def op11_cover_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_codes.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_warc_zstd", warc_zstd.SQL)
def op12_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op13_token_align")
def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_align.report(documents(spark, sf_dir), a, b)
