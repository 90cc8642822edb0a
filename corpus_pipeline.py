"""A corpus pipeline of the llm operators: toxicity, exact and near duplicates, mixing, packing.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, minhash, mixing, packing, toxicity
from quillon.llm._common import crc_fold, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. Its labels are those of the table; without any, every document stays. Null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 5) != 0)
    return toxicity.keep_documents(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) one document stays, the longest, then the smallest id; rows that repeat id and text give one. Null texts are empty ones."""
    return exact_dedup.keep_documents(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays; documents without words or without an id stay."""
    return minhash.keep_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document that is taken twice is there twice, one that is not taken is gone. A null source is one of its own; documents without words are not taken."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their sequence and place; a document that is there twice is packed twice. An empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the learned lexicon, ProbMinHash classes or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs


