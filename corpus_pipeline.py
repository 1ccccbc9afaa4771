"""The training-data pipeline: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage takes the documents that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import line_dedup, minhash, outliers, packing, pii
from glyphmill.llm.common import forget, settled
from glyphmill.sources.shared import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no outliers of their language and source."""
    return outliers.keep_regular(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the blocks of lines that an earlier document has; documents left without words go."""
    return line_dedup.deduplicate(docs, drop_empty=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in bins of one capacity."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: The stages are beyond SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each stage's result is a table in the shared folder, which the next reads; once that one's result is
    written, the table and what the stage stored on its way are deleted. Defined cases are those of the
    stages: a null or empty text passes all but the last, where it takes no place; null ids are never
    compared; repeated rows are one document's until near-duplicates go; an empty table gives an empty result;
    further columns of ``documents`` are kept up to the last stage.
    """
    return staged(spark, read_table(spark, sf_dir, "documents"), sf_dir)


def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = None
    for name, stage in STAGES:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
