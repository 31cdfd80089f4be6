"""Cleaning a corpus and mixing it: stages over `documents`, each written and read again.

Every stage works on all rows that the one before kept. The first four return the columns
of documents; the last returns the mix, one row per document that is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketlens.llm import decontaminate, langid, mixing, pii, simhash
from ticketlens.llm.common import stored, table
from ticketlens.llm.queries import BLOCK_WORDS, RADIUS, SHARD_SLOTS, SHINGLE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose words are in none of the learned languages, as far as the field can
    tell, and texts without letters; texts in several learned languages stay."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates."""
    return simhash.one_of_each(docs, SHINGLE, RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of its kinds."""
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: doc_id, source, size, source_size,
    target, taken."""
    return mixing.taken_words(mixing.mix_sources(docs, BLOCK_WORDS, SHARD_SLOTS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mix),
]

#: Language, fingerprints and the mix are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
