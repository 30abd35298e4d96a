"""Helpers shared by the operators: prepared documents, scratch tables and query registration."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row for joining results back: equal only for repeated rows."""
    return F.xxhash64(doc_id, text)


def narrow(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (bigint), ``text`` (never null) and ``row``, the key by which results return; other columns go."""
    doc_id, text = docs["doc_id"].cast("bigint"), text_of(docs)
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), row_key(doc_id, text).alias("row"), *[docs[c] for c in more])


def keep_rows(docs: DataFrame, kept: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose (doc_id, row) is in ``kept``.

    ``once`` lets only one of several rows with the same doc_id and text through.
    """
    last = F.lit(2**63 - 1)
    keys = kept.select(F.coalesce("doc_id", last).alias("__kept_id"), F.col("row").alias("__kept_row")).distinct()
    doc_id = docs["doc_id"].cast("bigint")
    own = docs.select(
        *[docs[c] for c in docs.columns], F.coalesce(doc_id, last).alias("__kept_id"), row_key(doc_id, text_of(docs)).alias("__kept_row")
    )
    found = own.join(keys, ["__kept_id", "__kept_row"], "left_semi")
    if once:
        repeats = Window.partitionBy("__kept_id", "__kept_row").orderBy(F.lit(0))
        found = found.withColumn("__repeat", F.row_number().over(repeats)).where("__repeat = 1").drop("__repeat")
    return found.drop("__kept_id", "__kept_row")


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id written as text, modulo ``parts`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
