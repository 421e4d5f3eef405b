"""Corpus pipeline: five stages from raw documents to a mix, each written as Parquet and read again by the next.

Language ID drops what it rejects, exact dedup and near-dedup keep one document of a group, decontamination drops
documents that hold a benchmark window, mixing adds each document's share of the mix. Each stage works on all that the one
before kept.

Odd input: null, blank and letterless texts go in the language stage; nulls in other columns are kept as they are. Rows
without a doc_id are never dropped as copies of each other. Repeated rows share one fate in the dedup stages, and each has
its share of the mix. Texts of any length are judged whole; columns beyond COLUMNS are left out; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import common, decontaminate, exact_dedup, language_id, minhash, mixing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. The model learns from those of docs that are not held out."""
    told = language_id.classify(docs.select(*COLUMNS), language_id.trained_on(docs.select("doc_id", "text", "lang")))
    return told.where("not rejected").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.exact_groups(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, 0.8 or more) the one with the least id."""
    return minhash.deduplicated(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window, however long they are: a passage leaks just as well from a long text."""
    judged = decontaminate.contamination(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))
    return judged.where("n_hit = 0").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each; 0 for those that it leaves out."""
    return mixing.mixture(docs.select(*COLUMNS)).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The language and near-dedup stages can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
