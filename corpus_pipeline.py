"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import line_dedup, near_dedup, packing, quality_rules, secret_scan
from quadrille.llm.common import discard, materialise, read_table
from quadrille.llm.queries import WORD_BPE


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go; repeated rows are judged each; an empty table stays empty.
    """
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat others exactly or nearly.

    Null texts stay null, a text that loses all its lines is empty; rows that repeat an id are one document.
    """
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Texts without words, null ones too, are never copies and stay; rows equal in id and text stay together.
    """
    return near_dedup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts.

    Null and empty texts stay as they are; repeated rows are masked each.
    """
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens.

    A null text is empty and is one token, the end mark; an empty table has no pieces.
    """
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    path = None
    for nth, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            read = path
            docs, path = materialise(docs, f"stage-{name.replace(' ', '-')}")
            if read is not None:  # what the stage before wrote is read no more
                discard(spark, read)
    return docs
