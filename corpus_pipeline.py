"""A corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, folder of the tables) and returns the documents it keeps with all their columns, whatever their names; the
last one returns token ids. ``run`` writes each stage's result to the shared folder, reads it back as the next stage's documents, and then
removes the documents before it.

Empty tables go through all stages and stay empty. Rows are judged each; a null ``doc_id`` is kept like any other, but not seen as a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import bpe, decontaminate, line_quality, minhash, pii
from cohortry.llm.common import discard, written
from cohortry.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their source share.

    Null and empty texts go, as they have no words; a null source is a source of its own; copies are judged alike and count once.
    """
    return line_quality.apply_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id.

    Texts that are null or without words are no copies of each other; rows of one id count as one document and stay or go together.
    """
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat an item of the benchmark of three words or more; null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked; null texts stay null, repeated rows are masked alike."""
    return pii.mask_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of each row; null and empty texts have no ids."""
    ranks = bpe.load_ranks(vocabulary())
    return bpe.decode_digests(bpe.encode(docs, ranks), ranks, keep_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't say the merges of the last stage; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
