"""A corpus pipeline of four stages: quality, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run writes each stage's rows to the shared folder and
reads them as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattice.llm import bpe, minhash_dedup, mixing, quality
from lattice.llm._shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this corpus, rejects go; null, empty and blank texts are rejected."""
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id; rows of a null doc_id all stay."""
    return minhash_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights of sources and languages; one drawn twice comes as two rows."""
    return mixing.draw(docs, keep_unmatched=True)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text): the tokens of every row, and the text decoded from them; null and empty texts come back as they were."""
    return bpe.decode(bpe.encode(docs))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Trained classifiers, MinHash, min-cost flow and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
