"""How the driver's tables stand in for sequences, in both engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import checkpoint_dir, spread


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(list):
    """Collects queries; ``@registry.query(sql)`` registers under the function's name."""

    def query(self, sql: str | None = None):
        def add(fn):
            self.append(Query(fn.__name__, fn, sql))
            return fn

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences: the ACGT letters of the upper-cased text."""
    from sigloom.functions.sequences import sanitize

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return docs.select(F.col("doc_id").alias("sample_id"), "lang", "source", sanitize(F.upper("text")).alias("seq"))


def samples(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col(label).alias("group"), "source"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense feature matrix."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("values"),
        F.col("label").cast("string").alias("group"),
    )


SEQ = """seqs AS (SELECT doc_id AS sample_id, lang, source,
  regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"""


def counts_sql(*ks: int) -> str:
    """CTEs ``seqs`` and ``counts(sample_id, k, kmer, n)``."""
    ks_list = ", ".join(f"({k})" for k in ks)
    return f"""{SEQ},
  ks(k) AS (VALUES {ks_list}),
  counts AS (SELECT sample_id, k, kmer, count(*) AS n FROM (
    SELECT sample_id, k, unnest(list_transform(generate_series(1, length(seq) - k + 1),
      lambda i: substr(seq, i, k))) AS kmer
    FROM seqs, ks WHERE length(seq) >= k) GROUP BY ALL)"""


POINTS = """pts AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS "group",
  CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)"""
