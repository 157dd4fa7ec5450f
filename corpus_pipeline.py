"""The training-data pipeline over ``documents``: five stages, each written to the shared folder before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm import bpe, mixing, pii
from palate.llm.ngram_join import ngram_join
from palate.llm.pu_classifier import keep_good
from palate.llm.queries import tokenizer_path
from palate.session import stage

#: The classifier, the duplicate search and the sampling have no SQL form; tests compare stages with plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of repeated ids all rows of the group's first."""
    first = ngram_join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first_id")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["first_id"]), "left_semi")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    encoded = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.split()[0].lower())
    return docs
