"""The corpus pipeline: five operators of ``sigloom.llm`` in a row over a documents table.

Every stage takes the table its predecessor kept and returns the same columns; the last gives packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import queries as llm_queries
from sigloom.llm.common import Query, documents, labels, stored
from sigloom.llm.exact_dedup import survivors
from sigloom.llm.jaccard_join import representatives
from sigloom.llm.mixing import mixed
from sigloom.llm.packing import pack
from sigloom.llm.quality_classifier import accepted


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; it learns from the labels beside the table."""
    return accepted(docs, labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of equal texts, white space aside."""
    return survivors(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near duplicates."""
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the target weights; a document of a further epoch is a further row."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in the sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing", mixing),
    ("packing", packing),
]
#: a learned classifier and a tokenizer decide rows here, which SQL cannot; tests compare with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def registry() -> list:
    return [*llm_queries.registry(), Query("pipeline", run, ORACLE_SQL)]
