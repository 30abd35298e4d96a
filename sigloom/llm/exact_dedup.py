"""Exact deduplication as a stream with keyed state on disk.

Documents are first logged as slim rows (identifier, digests, length, locator). A stream reads the
log as it grows; its state, kept in RocksDB without expiry, holds for every digest how
many rows had it and the stable identifier and content locator of the row that stays. Where a
digest was hit more than once, the full texts are read again and compared byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, keep_rows, narrow, scratch
from sigloom.operators.skew import salted_join

LOG_SCHEMA = "doc_id bigint, row bigint, key string, other string, text_sha256 string, n_chars bigint, locator string"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # many small stores: without this, each reserves megabytes of disk for logs that stay nearly empty
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Text without any character of space, tab, line feed, vertical tab, form feed, carriage return."""
    for space in " \t\n\x0b\x0c\r":  # plain replacements search bytes, several times faster than a pattern
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _rank(n_chars: str, doc_id: str, locator: str, row: str) -> Column:
    """Greatest for the row that stays: most code points, then smallest id (null ids last), then locator, then row key."""
    return F.struct(
        F.col(n_chars).alias("n_chars"), F.col(doc_id).isNotNull().alias("known"), F.bitwise_not(F.col(doc_id)).alias("inverse"),
        F.col(doc_id).alias("doc_id"), F.col(locator).alias("locator"), F.col(row).alias("row"),
    )


def _digest(sha: Column) -> Column:
    return sha


def ingest(docs: DataFrame, folder: str, digest=_digest, files_per_batch: int = 10_000) -> None:
    """Append ``docs`` to the log in ``folder`` and let the stream take in everything that is new there.

    May be called again with later arrivals: the stream goes on from its checkpoint.
    """
    spark = docs.sparkSession
    rows = narrow(docs)
    text = normalised(F.col("text"))
    log = rows.select("doc_id", "row", "text", text.alias("normal")).select(
        "doc_id", "row", digest(F.sha2("normal", 256)).alias("key"), F.md5("normal").alias("other"),
        F.sha2("normal", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"),
        F.input_file_name().alias("locator"),
    )
    log.write.mode("append").parquet(f"{folder}/log")
    arrivals = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/log")
    # equal digests of a task meet before the shuffle, so a group of copies sends one row per task
    state = arrivals.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(_rank("n_chars", "doc_id", "locator", "row")).alias("stays")
    )
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/stream").start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def retained(spark: SparkSession, folder: str) -> DataFrame:
    """The state as a table: key, n_rows and the retained row's doc_id, n_chars and locator."""
    state = spark.read.format("statestore").load(f"{folder}/stream")
    values = state.schema["value"].dataType.fieldNames()
    counted, best = F.col("value")[values[0]], F.col("value")[values[1]]
    return state.select(
        F.col("key.key").alias("key"), counted.alias("n_rows"), best["doc_id"].alias("doc_id"),
        best["n_chars"].alias("n_chars"), best["locator"].alias("locator"),
    )


def checked_classes(docs: DataFrame, folder: str) -> DataFrame:
    """Classes of equal full texts among the rows whose digest was hit: key, other, group_size, keep_id, keep_row.

    The log names the rows behind every hit digest; their texts are fetched by identifier and
    meet, whole, in a grouping by digest and text that first combines inside each task. Two texts under both
    digests are an error, two under one digest are two classes.
    """
    spark = docs.sparkSession
    # written, so that its true size decides whether it is broadcast
    retained(spark, folder).where("n_rows > 1").select("key").write.parquet(f"{folder}/hits")
    hits = spark.read.parquet(f"{folder}/hits")
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log")
    last = F.lit(2**63 - 1)
    members = salted_join(log, hits, ["key"], ["row"]).groupBy(F.coalesce("doc_id", last).alias("id"), "row", "key").agg(
        F.max("locator").alias("locator")
    )
    texts = narrow(docs).withColumn("id", F.coalesce("doc_id", last)).join(members, ["id", "row"])
    equal = (
        texts.select("key", "doc_id", "row", "locator", F.length("text").cast("bigint").alias("n_chars"), normalised(F.col("text")).alias("normal"))
        .groupBy("key", "normal")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank("n_chars", "doc_id", "locator", "row")).alias("stays"))
    )
    slim = equal.select("key", F.md5("normal").alias("other"), "group_size", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row"))
    single = slim.groupBy("key", "other").agg(
        F.count(F.lit(1)).alias("texts"), F.first("group_size").alias("group_size"), F.first("keep_id").alias("keep_id"),
        F.first("keep_row").alias("keep_row"),
    )
    clash = F.raise_error(F.concat(F.lit("different texts share both digests: "), F.col("key")))
    return single.select(
        "key", "other", F.when(F.col("texts") > 1, clash.cast("bigint")).otherwise(F.col("group_size")).alias("group_size"), "keep_id", "keep_row"
    )


def exact_dedup(docs: DataFrame, digest=_digest, files_per_batch: int = 10_000) -> DataFrame:
    """Every document with the one that stays of its class of equal normalised texts.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256 and row (its key for joins). Null texts count as empty.
    A null doc_id ranks behind every id. Repeated rows (same id, same text) count as
    rows of their group and carry the same flags; an empty table gives no rows. Extra
    columns are ignored. ``digest`` maps the SHA-256 column to the state's key.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "exact-dedup")
    ingest(docs, folder, digest, files_per_batch)
    checked_classes(docs, folder).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes").withColumn("found", F.lit(True))
    log = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log")
    joined = salted_join(log, classes, ["key", "other"], ["row"], "left")
    keep_id = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id"))
    # an id alone does not name a row: it may be null, or repeated with another text
    stays = ~F.coalesce("found", F.lit(False)) | (F.col("row") == F.col("keep_row")) & F.col("doc_id").eqNullSafe(keep_id)
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        stays.alias("kept"), "text_sha256", "row",
    )


def survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class of equal texts, all columns kept; of repeated rows one stays."""
    return keep_rows(docs, exact_dedup(docs).where("kept"), once=True)


SQL = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = first_value(doc_id) OVER w AS kept, text_sha256 FROM n
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("row")


QUERIES = [Query("op1_exact_dedup", op1_exact_dedup, SQL)]
