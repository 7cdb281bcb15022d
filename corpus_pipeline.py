"""Corpus pipeline: each stage applies one operator to all that the stage before it kept.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and columns of any name have the
results that the operators' modules define; all stages but the last return the columns of documents. Documents without
an id are kept apart by their row number, and documents without words end with the mixing, which takes words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medlark.llm.common import durable, read
from medlark.llm.language import keep_identified
from medlark.llm.mixing import mix
from medlark.llm.packing import pack
from medlark.llm.secrets import redact, trained
from medlark.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those whose language is rejected go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; the models learn from the documents themselves."""
    return redact(docs, trained(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks; files are in that order."""
    return mix(docs).drop("mix_position")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, in the order of the files."""
    return pack(docs, with_ids=False)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]
#: SQL has no tokenizer, no XXH64 and no trained model; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
