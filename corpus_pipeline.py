"""The corpus pipeline: raw documents to packed batches, in stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import documents, save
from palisade.llm.exact_dedup import drop_copies
from palisade.llm.language_id import keep_languages
from palisade.llm.mixing import mix
from palisade.llm.near_dedup import drop_near_copies
from palisade.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language."""
    return keep_languages(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_copies(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mix by the sources' natural shares."""
    return mix(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket and a batch for each document; the batches of a bucket follow the mix."""
    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), as_given=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The language model, weighted sampling and bucket search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), name)
    return docs
