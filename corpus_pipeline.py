"""A corpus pipeline: documents pass through the stages in order, each written as Parquet and read again for the next one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanguard.llm import bpe, mixing, near_dups, quality, suffixes
from spanguard.llm.common import table
from spanguard.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language."""
    return quality.kept_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dups.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; a character that a cut goes through goes with it."""
    left = suffixes.remove_repeats(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")], as_text=True)
    return left.withColumnRenamed("kept", "text").withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with digests of the ids and of what they decode to."""
    path = public_tokenizers.path(bpe.MULTI)
    decoded = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "source", "text"), path), path)
    return bpe.digests(decoded.withColumn("token_ids", F.col("ids")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The encoder and the near-duplicate search have no form in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; what each returns is written to the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
