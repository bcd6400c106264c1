"""From raw documents to encoded ones: each stage takes what its predecessor kept.

``run`` writes each stage's rows below the session's shared scratch folder and
reads them back for the next, so that a lost executor costs one stage at most.
Once they are written, the rows of the stage before and what the stage wrote on
its way are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webcorpus.llm import decontamination, ngram_jaccard, quality_rules, sanitisation, sentencepiece_lattice
from webcorpus.session import settled


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes too."""
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links connect."""
    return ngram_jaccard.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced."""
    return sanitisation.sanitise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and the ids of the pieces."""
    model = sentencepiece_lattice.read_model(sentencepiece_lattice.default_model())
    return sentencepiece_lattice.encode(docs, model)


STAGES = [
    ("quality_rules", good),
    ("ngram_jaccard", distinct),
    ("decontamination", clean),
    ("sanitisation", private),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None  # SQL expresses neither the merges of SentencePiece nor spaced seeds


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kept(stages: list) -> DataFrame:
        """The rows that the last of ``stages`` keeps."""
        if not stages:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        *before, (name, stage) = stages
        return settled(lambda: stage(spark, kept(before), sf_dir), f"pipeline-{name}")

    return STAGES[-1][1](spark, kept(STAGES[:-1]), sf_dir)
