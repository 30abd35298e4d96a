"""Reproducible cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.skew import even_split, hash_rank, measured_join


def assign_folds(samples: DataFrame, v: int, seed: int, split_by: str | None = None) -> DataFrame:
    """Add ``fold`` (0..v-1): an even split of a seeded permutation of the samples.

    With ``split_by`` the distinct values of that column are split instead, and
    all samples of a value share its fold.
    """
    if v < 1:
        raise ValueError("at least one fold is needed")
    if split_by is None:
        ranked = hash_rank(samples, "sample_id", seed, "_rank")
        return ranked.withColumn("fold", even_split(F.col("_rank"), F.col("n"), v)).drop("_rank", "n")
    values = samples.select(F.col(split_by).alias("_value")).distinct()
    ranked = hash_rank(values, "_value", seed, "_rank")
    folds = ranked.select("_value", even_split(F.col("_rank"), F.col("n"), v).alias("fold"))
    keyed = samples.withColumn("_value", F.col(split_by))
    return measured_join(keyed, folds, ["_value"], ["sample_id"]).drop("_value")


def train_split(samples: DataFrame, fold: int) -> DataFrame:
    """Everything outside one fold."""
    return samples.where(F.col("fold") != fold)


def test_split(samples: DataFrame, fold: int) -> DataFrame:
    """One fold."""
    return samples.where(F.col("fold") == fold)


test_split.__test__ = False
