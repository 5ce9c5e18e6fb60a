"""A corpus pipeline of five stages; each works on all rows that its predecessor kept.

Quality rules drop documents, near-dedup keeps one document of each group, substring dedup takes repeated
passages out of the texts, the secret scan masks secrets, and packing puts what is left into batches. All
but the last return the columns of ``documents``; stages that change a text bring ``n_chars`` up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.chunks import drop_repeats
from skyloom.llm.common import shared_table
from skyloom.llm.packing import pack_documents
from skyloom.llm.quality import keep_good
from skyloom.llm.secrets import mask_secrets
from skyloom.llm.simhash import near_dedup


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; null and empty texts go, repeated rows stay as often as they came."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; a null id only where no other is."""
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what smaller doc_ids hold, too; null texts and rows of a null id stay as they are."""
    return _counted(drop_repeats(docs), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; null texts stay null."""
    return _counted(mask_secrets(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of each document that is left; null and empty texts are one token long."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("secrets", secrets),
    ("packing", packing),
]

#: Components, content-defined chunks and the dynamic program are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on all that the one before it kept; an empty table gives an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared_table(docs, name)
    return docs
