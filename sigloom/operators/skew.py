"""Joins and rankings that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from sigloom.session import stored

SALTS = 16
#: keys that a sketch reports, keys that it tracks to find them, and the rows of a key that one task shall join
HEAVY_KEYS = 1024
TRACKED_KEYS = 16384
ROWS_PER_SALT = 1_000_000
MAX_RANGES = 4096
HASH_BUCKET_DIGITS = 3


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join a long table with a short one, splitting hot keys.

    Rows of ``big`` are dealt over ``salts`` sub-keys by a hash of ``salt_by`` and
    each row of ``small`` is repeated once per sub-key, so a key that owns a third
    of ``big`` is joined by ``salts`` tasks. When ``small`` turns out to be under
    the broadcast threshold Spark still broadcasts it and shuffles nothing.
    """
    if salts & (salts - 1):
        raise ValueError("salts must be a power of two")
    # a masked hash is never null: a nullable salt would be filtered far below the join, once per input row
    salt = F.xxhash64(*[F.col(c) for c in salt_by]).bitwiseAND(F.lit(salts - 1).cast("bigint"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def _key_hash(df: DataFrame, on: Sequence[str]) -> Column:
    """One number for the join key; both zeros of a fractional key are one value, as they are to a join."""
    parts = [F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, FractionalType) else F.col(c) for c in on]
    return F.xxhash64(*parts)


def heavy_keys(df: DataFrame, on: Sequence[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys that own more than ``rows_per_salt`` rows: ``(_key, _salts)``, the hash of the key and its number of sub-keys.

    A frequent-items sketch of fixed size counts the keys in one pass over the key columns; its parts are merged, so no key is
    shuffled. A key below the ``HEAVY_KEYS`` most frequent ones owns less than a thousandth of all rows and is left whole.
    """
    top = df.select(_key_hash(df, on).alias("_key")).agg(F.expr(f"approx_top_k(_key, {HEAVY_KEYS}, {TRACKED_KEYS})").alias("_top"))
    found = top.select(F.explode("_top").alias("_t")).select(
        F.col("_t.item").alias("_key"), F.ceil(F.col("_t.count") / F.lit(rows_per_salt)).cast("bigint").alias("_salts")
    )
    return found.where(F.col("_salts") > 1)


def measured_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Equi-join of a long table with a short one whose keys are split by their measured size.

    A key with r rows in ``big`` is joined by r / ``rows_per_salt`` tasks and its rows of ``small`` are repeated as often; all
    other keys stay whole and nothing is repeated for them. Sizes are estimates: they decide only how rows are dealt. ``big`` is
    read twice, once for its key columns alone.
    """
    unlike = [c for c in on if big.schema[c].dataType != small.schema[c].dataType]
    if unlike:
        raise ValueError(f"key columns of different types: {unlike}")
    heavy = heavy_keys(big, on, rows_per_salt)
    salts = F.coalesce(F.col("_salts"), F.lit(1).cast("bigint"))
    # never null: a nullable salt would be filtered far below the join, once per input row
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), salts), F.lit(0).cast("bigint"))
    # HEAVY_KEYS rows of two numbers at most
    long = big.withColumn("_key", _key_hash(big, on)).join(F.broadcast(heavy), "_key", "left").withColumn("_salt", salt)
    copies = small.withColumn("_key", _key_hash(small, on)).join(F.broadcast(heavy), "_key", "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return long.drop("_key", "_salts").join(copies.drop("_key", "_salts"), [*on, "_salt"], how).drop("_salt")


def _with_offsets(counts: DataFrame, order: Sequence[str], of: str = "_n") -> DataFrame:
    """Running row offsets over a bucket table; its row count is bounded by the caller."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(of).over(before), F.lit(0)))


def hash_rank(df: DataFrame, key: str, seed: int | str, name: str = "rank") -> DataFrame:
    """0-based position of every ``key`` in the order of ``md5(seed:key)``, plus ``n``.

    The hash is uniform, so its leading digits cut the ids into equal buckets: rows
    are ranked inside a bucket and shifted by the size of the earlier buckets. Only
    the table of 16^3 bucket sizes is ever ordered in one task.
    """
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    hashed = df.withColumn("_h", F.md5(text)).withColumn(
        "_bucket", F.substring("_h", 1, HASH_BUCKET_DIGITS)
    )
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = _with_offsets(counts, ["_bucket"]).select(
        "_bucket", "_before", F.sum("_n").over(whole).alias("n")
    )
    inside = Window.partitionBy("_bucket").orderBy("_h", key)
    return (
        # at most 16^3 rows of three small columns
        hashed.join(F.broadcast(sizes), "_bucket")
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_before")).cast("bigint"))
        .drop("_h", "_bucket", "_before")
    )


def ordinal_rank(
    df: DataFrame, group: str, position: str, name: str, width: int = 65536, ties: Sequence[str] = ()
) -> DataFrame:
    """1-based number over all rows in the order (``group``, ``position``, ``ties``).

    Rows are cut into ranges of that order, of about ``width`` rows or at most ``MAX_RANGES`` ranges, whose borders Spark takes from a sample; so
    neither the gaps between positions nor the size of a group matter. The ranges are stored, which fixes them
    for both of their readers: their sizes are added up in one table of a row per range, and rows are ranked inside their range.
    """
    ranges = max(1, min(MAX_RANGES, -(-df.count() // width)))
    dealt = df.repartitionByRange(ranges, group, position, *ties).withColumn("_range", F.spark_partition_id())
    ranged = stored(dealt, "ranges")
    offsets = _with_offsets(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), ["_range"])
    inside = Window.partitionBy("_range").orderBy(group, position, *ties)
    numbered = ranged.withColumn("_in", F.row_number().over(inside))
    return (
        # at most MAX_RANGES rows of two numbers
        numbered.join(F.broadcast(offsets.select("_range", "_before")), "_range")
        .withColumn(name, (F.col("_in") + F.col("_before")).cast("bigint"))
        .drop("_range", "_in", "_before")
    )


def even_split(rank: Column, n: Column, parts: int) -> Column:
    """Part of a 0-based rank when ``n`` rows are cut into ``parts`` even pieces.

    The first ``n mod parts`` pieces hold one row more than the others.
    """
    size = F.floor(n / F.lit(parts)).cast("bigint")
    larger = F.pmod(n, F.lit(parts)).cast("bigint")
    border = larger * (size + 1)
    return (
        F.when(rank < border, F.floor(rank / (size + 1)))
        .otherwise(larger + F.floor((rank - border) / F.greatest(size, F.lit(1))))
        .cast("int")
    )
