"""A training corpus from raw documents: each stage's result is written as Parquet and read again as the next one's input.

Null text, empty text and text without words go in the first stage, as too short. Rows that repeat a doc_id stay or go together in near
deduplication and are judged alone elsewhere; null doc_ids are in no group of copies and are drawn alike. Very long texts are read whole.
Other columns are carried, whatever their names. Empty tables give no rows. A stage's intermediate tables are deleted once its result is
written; what the last stage's result reads stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelode.llm import common, decontaminate, line_dedup, minhash, mixing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring template lines, all but the first, and documents that this takes below the first stage's number of words."""
    return line_dedup.deduplicate_lines(docs, quality.MIN_WORDS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.deduplicate(docs, shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by raked weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        with common.Scope() as scope:
            docs = scope.kept(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            before.drop()
        (before,) = scope.stays
    return STAGES[-1][1](spark, docs, sf_dir)


#: The near-duplicate stage is tested against a brute-force version instead.
ORACLE_SQL = None
