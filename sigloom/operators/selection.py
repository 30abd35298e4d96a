"""Choosing labelled entries: groups, predicates, datasets, archive members, numbering."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.sequences import ordinal_name
from sigloom.operators.skew import measured_join, ordinal_rank


def groups_by_value(metadata: DataFrame, key: str, min_pts: int) -> DataFrame:
    """One group per value of ``key`` with at least ``min_pts`` entries; null and empty are dropped."""
    value = F.col(key).cast("string")
    return (
        metadata.where(value.isNotNull() & (value != ""))
        .groupBy(value.alias("group"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_pts)
        .select("group", F.array("group").alias("values"))
    )


def make_groups(metadata: DataFrame, options: Mapping, groups: Callable[[Mapping, DataFrame], DataFrame]) -> DataFrame:
    """Group table built by the caller's function of (options, metadata)."""
    return groups(options, metadata)


def value_in_group(key: str, values: str = "values") -> Column:
    """The entry's value of ``key`` is one of the group's values."""
    return F.array_contains(F.col(values), F.col(key).cast("string"))


def exclude_flagged(df: DataFrame, flag: str, include: bool) -> DataFrame:
    """Drop flagged entries unless ``include``; a missing flag counts as false."""
    return df.where(F.lit(include) | ~F.coalesce(F.col(flag), F.lit(False)))


def label_by(df: DataFrame, key: str) -> DataFrame:
    """Label entries by a column named at run time."""
    return df.withColumn("group", F.col(key).cast("string"))


def with_dataset(groups: DataFrame, default: Mapping[str, str | None]) -> DataFrame:
    """Fill groups without a dataset of their own with the experiment's dataset, as a whole."""
    parts = ("archive", "archive_folder", "metadata")
    own = F.col("archive").isNotNull() if "archive" in groups.columns else F.lit(False)
    filled = {
        part: F.when(own, F.col(part) if part in groups.columns else F.lit(None)).otherwise(F.lit(default.get(part)))
        for part in parts
    }
    return groups.withColumns({part: col.cast("string") for part, col in filled.items()})


def _entry_key(entries: DataFrame) -> str:
    """The column that tells entries apart."""
    return next((c for c in ("entry_no", "id", "sample_id") if c in entries.columns), entries.columns[0])


def pick_group(metadata: DataFrame, groups: DataFrame, key: str, predicate: Column | None = None) -> DataFrame:
    """Entries whose value of ``key`` a group lists, tagged with its name: one row per (entry, group).

    An equi-join on the exploded group values; a value that owns many entries is split by
    their measured number. ``predicate`` further filters the matches and may use
    entry and group columns.
    """
    exploded = groups.withColumn("_value", F.explode(F.array_distinct("values")))
    entries = metadata.withColumn("_value", F.col(key).cast("string"))
    picked = measured_join(entries, exploded, ["_value"], [_entry_key(metadata)]).drop("_value", "values")
    return picked if predicate is None else picked.where(predicate)


def pick_by_function(
    metadata: DataFrame,
    groups: Sequence[Mapping],
    choose: Callable[[DataFrame, Mapping, Mapping], Column | DataFrame],
    options: Mapping | None = None,
) -> DataFrame:
    """Entries chosen by a function of (metadata, group options, experiment options).

    The function returns a condition or a table. Conditions of all groups are
    tested in a single pass over the metadata, without a join: an entry is repeated
    once per group that takes it. Tables are united, duplicates kept.
    """
    chosen = [(group["group"], choose(metadata, group, dict(options or {}))) for group in groups]
    conditions = [(name, c) for name, c in chosen if isinstance(c, Column)]
    parts = [c.withColumn("group", F.lit(name)) for name, c in chosen if not isinstance(c, Column)]
    if conditions:
        takers = F.array(*[F.when(c, F.lit(name)) for name, c in conditions])
        parts.insert(0, metadata.withColumn("group", F.explode(F.array_compact(takers))))
    return union_groups(parts)


def union_groups(selections: list[DataFrame]) -> DataFrame:
    """Per-group selections one after the other; an entry picked twice stays twice."""
    united = selections[0]
    for part in selections[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return united


def with_group_options(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach the options of each entry's group."""
    return measured_join(entries, groups, ["group"], [_entry_key(entries)])


def resolve_member(df: DataFrame) -> DataFrame:
    """Path of an entry in its archive: ``filename``, else ``[folder/]id.fasta``."""
    own = F.col("filename") if "filename" in df.columns else F.lit(None).cast("string")
    folder = F.col("archive_folder") if "archive_folder" in df.columns else F.lit(None).cast("string")
    named = F.concat(F.col("id").cast("string"), F.lit(".fasta"))
    return df.withColumn("member", F.coalesce(own, F.concat_ws("/", folder, named)))


def explode_members(df: DataFrame, postprocess: bool = True) -> DataFrame:
    """One row per member file: the ``filenames`` of an entry in order, else its one member.

    Several files per entry count only when a postprocess step will take them.
    """
    single = resolve_member(df)
    if not postprocess or "filenames" not in df.columns:
        return single.withColumn("part", F.lit(0))
    members = F.when(F.col("filenames").isNotNull(), F.col("filenames")).otherwise(F.array("member"))
    others = [c for c in single.columns if c != "member"]
    return single.select(*others, F.posexplode(members).alias("part", "member"))


def number_samples(entries: DataFrame, position: str = "entry_no", ties: Sequence[str] = ()) -> DataFrame:
    """Number the picked entries from 1, in group order and then entry order, and name their files.

    ``ties`` orders several rows of one entry.
    """
    numbered = ordinal_rank(entries, "group", position, "sample_no", ties=ties)
    return numbered.withColumn("filename", ordinal_name("sample_no"))
