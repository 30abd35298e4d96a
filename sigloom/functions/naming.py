"""Column functions over run names, result file names and report labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN_K = "-k=([0-9]+)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_run(name: Column | str) -> Column:
    """``struct<base, k>`` of a run name; a name without a k is an error."""
    col = _col(name)
    digits = F.regexp_extract(col, _RUN_K, 1)
    k = F.when(digits != "", digits.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("run name has no parameter k: "), col)).cast("int")
    )
    return F.struct(F.regexp_replace(col, _RUN_K, "").alias("base"), k.alias("k"))


def natural_key(text: Column | str) -> Column:
    """Sort key that compares digit runs as numbers: ``array<struct<text, num>>``."""
    col = _col(text)
    words = F.split(col, "[0-9]+")
    numbers = F.transform(
        F.regexp_extract_all(col, F.lit("([0-9]+)"), F.lit(1)),
        lambda digits: digits.cast("decimal(38,0)"),
    )
    return F.transform(
        F.arrays_zip(words.alias("text"), numbers.alias("num")),
        lambda part: F.struct(part["text"].alias("text"), part["num"].alias("num")),
    )


def dist_name(path: Column | str) -> Column:
    """Name between ``classification-`` and ``.json`` in a result path."""
    return F.regexp_extract(_col(path), r"classification-([^/]*)\.json(?:/[^/]*)?$", 1)


def percent_label(cls: Column | str, probability: Column | str) -> Column:
    """``A1 (97.3%)``."""
    return F.format_string("%s (%.1f%%)", _col(cls), _col(probability) * 100)


def run_info(k: Column | str, dist: Column | str, classifier: Column | str) -> Column:
    """``k=4, kmers, linear-svm``."""
    return F.format_string("k=%s, %s, %s", _col(k).cast("string"), _col(dist), _col(classifier))
