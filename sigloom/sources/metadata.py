"""Metadata scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_metadata(
    spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """JSON list of entries as rows, with ``entry_no`` giving their order, files in the order of their names.

    Rows are numbered inside the blocks that tasks read, and blocks shifted by the rows before them: only the
    table of blocks is ordered in one place. A JSON list is one document and is parsed by one task; long lists should be
    stored as JSON lines (``lines=True``), which split. Pass a schema to avoid the
    inference pass.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")]
    read = reader.json(path)
    rows = read.select(*read.columns, *block, F.monotonically_increasing_id().alias("_row"))
    keys = ["_file", "_at"]
    before = F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_row")) - 1
    numbered = rows.withColumn("_row", inside).join(blocks, keys)
    return numbered.withColumn("entry_no", (F.col("_row") + F.col("_before")).cast("bigint")).select(*read.columns, "entry_no")
