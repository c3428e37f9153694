"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and gives the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import bpe, exact_dedup, mixing, near_copies, toxicity
from newsloom.llm.common import table
from newsloom.llm.queries import vocabulary
from newsloom.session import materialize, release


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (0.8 or more of five-word shingles in common, and what these link), the document with the smallest doc_id stays."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of each document."""
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact), ("simhash near-dedup", drop_near), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can express neither the classifier nor the encoder; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")), docs
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
