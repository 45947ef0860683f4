"""A training-data pipeline: toxicity, quality rules, near duplicates, personal data, packing.

Each stage takes all that its predecessor kept and writes Parquet that the next one reads. The first four return
the columns of ``documents``; the last returns the packed sequences' pieces.

Defined results, in every stage: rows are judged one by one, so repeated rows share their verdict, until the near-duplicate
stage keeps one row of each group; a null id is a document like another, and never the one that stays beside a known id;
nulls in other columns are kept as they are; extra columns pass, whatever their names; an empty table gives an empty one.
A null or empty text scores 0 for toxicity and stays there, and goes at the quality rules, as it has under 50 words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import jaccard, packing, pii, quality, toxicity
from tidebook.llm.common import read, stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; trained on the labels of the documents given."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the current policy go."""
    return quality.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the smallest id stays."""
    return jaccard.deduplicated(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; n_chars is left as it was read."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact_private),
    ("best_fit_packing", pack_sequences),
]

#: Training and tokenising are not expressible in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
