"""The corpus pipeline: language ID, near-dedup, PII, mixing and BPE over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents, further ones included, whatever their names; the last returns the token ids of every row of the mix. An
empty table gives an empty table. Texts are worked on whole, however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, langid, mixing, neardup, pii
from tessella.llm.queries import vocabulary_path
from tessella.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; a missing lang is filled in.

    Null and empty texts and texts without a letter have none. Repeated rows are judged alike; a null doc_id, lang or
    source is no reason to go. If no document says its language, none can be learned, and all go.
    """
    ship_package(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of least doc_id stays.

    Null texts and null ids stay; empty texts are copies of each other. Rows equal in id and text stay or go together,
    since nothing tells them apart; rows of equal id and different text are different documents.
    """
    ship_package(spark)
    return neardup.drop_near_duplicates(docs, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind's name; every document stays, repeated rows as well, null texts as null."""
    ship_package(spark)
    return pii.mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document that the mix takes, by shard and in the shard's order.

    Null texts and texts without words are never taken. Rows of null id or source, and repeated rows, are drawn like others.
    """
    ship_package(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text; a null text counts as empty."""
    ship_package(spark)
    return bpe.encode_documents(docs, vocabulary_path(), decoded=False)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("encode", encode)]

#: Near-dedup, mixing and BPE can't be stated in SQL; tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
