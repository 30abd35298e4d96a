"""Zipped archive scan, and archives written by Spark."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import workers_open

BATCH_BYTES = 8_000_000
ARCHIVE_BYTES = 16_000_000


def open_shared(uri: str):
    """Seekable file on a shared file system, so that a reader fetches only what it needs."""
    if uri.startswith("file:"):
        return open("/" + unquote(uri.removeprefix("file:")).lstrip("/"), "rb")
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def _listed(opened: zipfile.ZipFile, archive: str, path: str) -> pd.DataFrame:
    """Rows also of an archive without members are of strings: Arrow takes no empty column of numbers for one."""
    names = [n for n in opened.namelist() if not n.endswith("/")]
    return pd.DataFrame([(archive, path, n) for n in names], columns=["archive", "path", "member"], dtype=object)


def _list_members(open_file: Callable):
    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, path in zip(batch["archive"], batch["path"]):
                with open_file(path) as raw, zipfile.ZipFile(raw) as opened:
                    yield _listed(opened, archive, path)

    return listing


def _unpacked(opened: zipfile.ZipFile, archive: str, names) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for name in names:
        rows.append((archive, name, opened.read(name).decode("utf-8", "replace")))
        held += len(rows[-1][2])
        if held >= BATCH_BYTES:
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])
            rows, held = [], 0
    yield pd.DataFrame(rows, columns=["archive", "member", "content"], dtype=object)


def _read_members(open_file: Callable):
    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (archive, path), wanted in batch.groupby(["archive", "path"]):
                with open_file(path) as raw, zipfile.ZipFile(raw) as opened:
                    yield from _unpacked(opened, archive, wanted["member"])

    return reading


def _list_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, path, content in zip(batch["archive"], batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as opened:
                yield _listed(opened, archive, path)


def _read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, content, names in zip(batch["archive"], batch["content"], batch["members"]):
            with zipfile.ZipFile(io.BytesIO(content)) as opened:
                yield from _unpacked(opened, archive, names)


def read_archive(
    spark: SparkSession, path: str, members: DataFrame | None = None, open_file: Callable | None = None, pattern: str = "*.zip"
) -> DataFrame:
    """Members of zip files: ``(archive, member, content)``; ``archive`` is the file name without ``.zip``.

    The directory of each archive is listed first; then the members, not the
    archives, are dealt over the tasks, so one large archive is read by many. A
    ``members(archive, member)`` table restricts the read to those before any is
    unpacked. ``open_file`` opens a path of the shared file system on a worker. In a store
    that workers cannot open, Spark reads the archives, each one whole, and one task unpacks its members.
    """
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files = files.withColumn("archive", F.regexp_replace(name, r"\.zip$", ""))
    schema, read_schema = "archive string, path string, member string", "archive string, member string, content string"
    if open_file is None and not workers_open(files, path):
        listed = files.select("archive", "path", "content").mapInPandas(_list_contents, schema)
        if members is not None:
            listed = listed.join(members.select("archive", "member").distinct(), ["archive", "member"], "left_semi")
        wanted = listed.groupBy("archive", "path").agg(F.sort_array(F.collect_list("member")).alias("members"))
        whole = files.select("path", "content").join(wanted, "path")
        return whole.select("archive", "content", "members").mapInPandas(_read_contents, read_schema)
    # only the paths are selected: Spark does not read the contents
    listed = files.select("archive", "path").mapInPandas(_list_members(open_file or open_shared), schema)
    if members is not None:
        listed = listed.join(members.select("archive", "member").distinct(), ["archive", "member"], "left_semi")
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = listed.select("archive", "path", "member").repartition(slots, "archive", "member")
    return dealt.sortWithinPartitions("archive", "member").mapInPandas(_read_members(open_file or open_shared), read_schema)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Zip archives of about ``ARCHIVE_BYTES`` before packing, without their last byte; a task without rows makes an empty one."""

    def done() -> pd.DataFrame:
        out.comment = b"\n"
        out.close()
        return pd.DataFrame({"value": [raw.getvalue()[:-1]]})

    raw, held = io.BytesIO(), 0
    out = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
    for batch in batches:
        for member, content in zip(batch["member"], batch["content"]):
            if held >= ARCHIVE_BYTES:
                yield done()
                raw, held = io.BytesIO(), 0
                out = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
            folder, _, file = member.rpartition("/")
            out.writestr(f"{folder}/{len(out.filelist)}/{file}", content)
            held += len(content)
    yield done()


def write_archives(df: DataFrame, path: str) -> None:
    """Pack ``(member, content)`` into zip archives ``part-*`` under ``path``, several to a task.

    Each member gets a folder numbered within its archive, so repeated names stay apart. Spark's text
    writer writes them, and so reaches every store that Spark does: an archive ends with a comment of one line feed, which that
    writer adds after a row.
    """
    packed = df.select("member", "content").mapInPandas(_packed, "value binary")
    raw = packed.select(F.col("value").cast("string").alias("value"))
    raw.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
