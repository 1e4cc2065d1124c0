"""Corpus pipeline: toxic and poor documents go, one of each near-duplicate group stays, contaminated ones go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactlane.llm import decontam, jaccard, packing, quality_gam, simhash, toxicity_cnn
from pactlane.llm.common import table, written
from pactlane.llm.tokens import vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier, fitted on the labelled rows of docs, doesn't reject."""
    return toxicity_cnn.drop_toxic(docs, toxicity_cnn.train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labelled rows of docs, doesn't reject."""
    return quality_gam.drop_poor(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles (Jaccard 0.8 or more) or SimHash fingerprints link: that of the least id."""
    return simhash.one_each(docs, found=jaccard.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to four fifths of its five-word shingles."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, with the ids of each."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: No SQL expresses the trained stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
