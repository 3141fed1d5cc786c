"""The corpus pipeline: quality rules, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents` (and whatever other columns docs have, under any
names), for every document that stays. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytequarry.llm import decontaminate, linededup, nearduplicates, packing, quality
from bytequarry.llm.base import materialize, table
from bytequarry.llm.queries import BYTE_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds.

    Null and empty texts have no words and go; null languages and sources are groups of their own; equal rows are
    judged alike; long texts are measured whole."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand at an earlier place; those of which nothing is left go.

    Null texts have no lines and stay; empty texts stay; of equal rows the first keeps its lines and the others go;
    null ids come before all others."""
    return linededup.dedup(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id (null ids last, ties by row).

    Each null text is a class of its own; texts without words are copies if they are equal, empty ones too."""
    return nearduplicates.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that occur in the benchmark; documents with more than half their words there go.

    Null and empty texts have no words and stay; equal rows are treated alike, each on its own; items without words
    and an empty benchmark change nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, in sequences.

    Null and empty texts are the end id alone; equal rows are packed each on its own; null ids stay null."""
    return packing.pack(docs, BYTE_BPE, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmark_decontamination), ("packing", pack)]

#: Tokenization and sketches by permutation can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
