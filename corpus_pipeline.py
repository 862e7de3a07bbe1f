"""A training corpus from raw documents: five stages, each of them one operator.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of documents. Null texts, empty tables, repeated rows and further columns are
handled as each operator's docstring says: a null or letterless text goes with the
language stage, and of repeated rows the exact dedup leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import exact_dedup, language, mixing, near_copies, packing
from cohortloom.llm.queries import BYTE_BPE, END_ID
from cohortloom.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that compression rejects go."""
    return language.kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequences."""
    return packing.pack_documents(docs, BYTE_BPE, END_ID)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]
# Compression, fingerprints and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
