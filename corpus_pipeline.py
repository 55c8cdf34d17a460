"""The corpus pipeline: five stages, each one of the text operators.

A stage gets the documents that its predecessor kept and returns those it keeps,
with the columns of ``documents``; the last returns the encoded documents.  Every
stage is written as Parquet in the shared folder and read again, so a lost
executor never costs more than the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import decontaminate, lines, neardup, pieces, toxicity
from tallyweave.llm.common import read_table
from tallyweave.llm.queries import sentencepiece_model
from tallyweave.session import cut_lineage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the scorer is trained on the labels of these documents."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those left without a word go.

    ``n_chars`` follows the text where the table has it.
    """
    out = lines.deduplicate_lines(docs, drop_emptied=True)
    if "n_chars" in out.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return out


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicate(docs, threshold=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each document, with an end id."""
    return pieces.encode_documents(docs, sentencepiece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_near),
    ("decontamination", remove_benchmark),
    ("sentencepiece", encode),
]

#: A trained scorer and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
