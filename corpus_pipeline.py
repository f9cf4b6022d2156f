"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  All
but the last return the columns of ``documents``; the last, packing, returns the
pieces of every document that is left and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact, near, packing, pii, toxicity
from corvane.llm.shared import documents, materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from this stage's own labelled documents, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(toxicity.labelled_sample(docs, labels)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, white space aside, the one that the registry keeps, whatever their ids."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), one row with the smallest doc_id."""
    return near.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts."""
    return pii.mask_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The toxicity, near-duplicate, PII and packing stages learn, sketch and tokenise,
#: which SQL can't; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
