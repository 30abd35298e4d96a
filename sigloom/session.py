"""Session helpers: building one for local use, and finding the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = f"{tempfile.gettempdir()}/sigloom-checkpoints"


def local_session(name: str = "sigloom", cores: str = "8", memory: str = "16g") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset and gets one; on a cluster that is an error, since executors could not see it.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(LOCAL_CHECKPOINTS)
    return sc.getCheckpointDir()


def workers_open(files: DataFrame, path: str) -> bool:
    """Whether Python on a worker can open the files read from ``path``; those of other stores are reached only by Spark's readers.

    A path that names no store is in the one of its files.
    """
    if ":" not in path:
        path = next((r[0] for r in files.select("_metadata.file_path").take(1)), "file:")
    return path.partition(":")[0] in ("file", "s3", "s3a", "gs")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has task slots.

    Row-multiplying work (k-mer extraction) on a scan of a few small files would
    otherwise run in a handful of tasks. Scans of many splits are left alone, so
    no shuffle of the raw data is added at scale. Only for plans without a
    shuffle of their own: the split count is read from the planned scan.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def dealt(df: DataFrame, tasks: int) -> DataFrame:
    """Rows for many passes in about ``tasks`` partitions: small tables get few, and larger ones at least a partition per task slot.

    More than a partition per slot is only kept, never made. For plans on cached rows: the split count is read from the planned scan.
    """
    have, wanted = df.rdd.getNumPartitions(), max(1, tasks)
    if have > wanted:
        return df.coalesce(wanted)
    slots = min(wanted, df.sparkSession.sparkContext.defaultParallelism)
    return df if have >= slots else df.repartition(slots)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the length of one read or write."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_listers(spark: SparkSession):
    """Folders listed by a few tasks per slot: by default Spark starts a task for each of up to 10,000 folders."""
    return setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))


def gathered(df: DataFrame) -> DataFrame:
    """A scan of very many small files in at most 64 tasks per slot."""
    return df.coalesce(64 * df.sparkSession.sparkContext.defaultParallelism)
