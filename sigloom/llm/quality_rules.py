"""Quality rules by an isolation forest over rule statistics.

Documents that random splits set apart after a few steps are anomalous. Every labelled row grows at least one tree, and the
threshold on the path length is the one that catches most of all rows of label 0 while losing at most a stated share of all rows of
label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import textstats
from sigloom.llm.common import Query, documents, labels, narrow, stored
from sigloom.llm.textops import small

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Settings:
    """Trees, rows that a tree gets at least (of as many), and the share of clean rows that may be lost."""

    trees: int = 200
    tree_rows: int = 256
    max_clean_loss: float = 0.01
    seed: int = 7


def _unsuccessful(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def depth_limit(size: int) -> int:
    return max(1, int(np.ceil(np.log2(max(size, 2)))) + 2)


class IsolationForest:
    """Trees over random features and random split points, as arrays of nodes."""

    def __init__(self, rows: np.ndarray, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.size = min(settings.tree_rows, len(rows))
        self.limit = depth_limit(self.size)
        self.trees = [self.grown(rows[rng.choice(len(rows), self.size, replace=False)], self.limit, rng) for _ in range(settings.trees)]

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], size: float, limit: int) -> IsolationForest:
        """A forest of grown trees of ``size`` rows on average."""
        forest = cls.__new__(cls)
        forest.trees, forest.size, forest.limit = trees, size, limit
        return forest

    @staticmethod
    def grown(rows: np.ndarray, limit: int, rng) -> tuple[np.ndarray, ...]:
        feature, split, left, depth = [], [], [], []
        todo = [(rows, 0)]
        for own, level in todo:  # the list grows while it is walked: nodes are numbered in this order
            spread = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(own) > 1 and level < limit else ()
            if len(spread) == 0:
                feature.append(-1), split.append(0.0), left.append(0)
                depth.append(level + float(_unsuccessful(len(own))))
                continue
            j = int(rng.choice(spread))
            at = rng.uniform(own[:, j].min(), own[:, j].max())
            feature.append(j), split.append(at), left.append(len(todo)), depth.append(0.0)
            todo += [(own[own[:, j] <= at], level + 1), (own[own[:, j] > at], level + 1)]
        return np.array(feature), np.array(split), np.array(left), np.array(depth)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score between 0 and 1 of every row: 2 ** -(mean path length / expected length)."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, split, left, depth in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.limit + 1):
                j = feature[node]
                inner = j >= 0
                if not inner.any():
                    break
                right = rows[each, np.maximum(j, 0)] > split[node]
                node = np.where(inner, left[node] + right, node)
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_unsuccessful(self.size)), 1e-9))


@dataclass(frozen=True)
class Model:
    """Forest and threshold; without a forest (no labelled rows) the method keeps every document."""

    forest: IsolationForest | None
    threshold: float

    def scores(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        if self.forest is None:
            return np.zeros(len(counts["n_words"]))
        return self.forest.scores(textstats.letter_rates(counts))


def base_failed(counts) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def labelled(counted: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of labelled documents with their quality. Each label counts once."""
    known = marks.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max("quality").cast("int").alias("quality")
    )
    return counted.join(known, "doc_id")


def statistics(batches):
    """Arrow batches with ``text`` -> the same rows with all counts in the text's place."""
    for batch in small(batches):
        counts = textstats.count_columns(batch.column("text"))
        kept = [(name, batch.column(name)) for name in batch.schema.names if name != "text"]
        columns = [c for _, c in kept] + [pa.array(counts[name], pa.int64()) for name in textstats.COUNTS]
        yield pa.RecordBatch.from_arrays(columns, [name for name, _ in kept] + list(textstats.COUNTS))


def fit(docs: DataFrame, marks: DataFrame, settings: Settings = Settings()) -> Model:
    """Grow the forest and calibrate its threshold on all labelled rows, whose statistics are counted once and stored.

    Texts are counted where they are read: only their statistics meet the labels.
    """
    schema = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in textstats.COUNTS)
    counted = narrow(docs).select("doc_id", "text").mapInArrow(statistics, schema)
    rows = stored(labelled(counted, marks).select("doc_id", "quality", *textstats.COUNTS), "quality-statistics")
    n = rows.count()
    if not n:
        return Model(None, 1.0)
    forest = grow_forest(rows, n, settings)
    cells, counts, clean = score_histogram(rows, forest)
    return Model(forest, calibrated(cells / CELLS, clean, settings.max_clean_loss, counts, between=False))


#: steps of the score at which the threshold may lie
CELLS = 1 << 16


def _counts(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {name: np.asarray(batch.column(name)) for name in textstats.COUNTS}


def grow_forest(rows: DataFrame, n: int, settings: Settings) -> IsolationForest:
    """Every row is dealt to one tree by a hash, and where that gives a tree too few rows, to further trees by chance.

    A tree is grown where its rows meet: one part in ``trees`` of all, four numbers each. Its depth, and so the forest, is bounded.
    """
    limit = depth_limit(min(settings.tree_rows, n))
    more = min(1.0, settings.tree_rows / n)
    seed, steps = F.lit(settings.seed), F.lit(1 << 30)
    home = F.pmod(F.xxhash64("doc_id", seed), F.lit(settings.trees))
    by_chance = F.filter(
        F.sequence(F.lit(0), F.lit(settings.trees - 1)),
        lambda t: (t == home) | (F.pmod(F.xxhash64("doc_id", t, seed), steps) < int(more * (1 << 30))),
    )

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", *textstats.COUNTS)])
        tree = IsolationForest.grown(textstats.letter_rates(_counts(table)), limit, np.random.default_rng([settings.seed, key[0].as_py()]))
        parts = dict(zip(("feature", "split", "near", "depth"), ([x.tolist()] for x in tree)))
        return pa.table({"tree": [key[0].as_py()], "size": [len(table)], **parts}, schema=shape)

    numbers, reals = pa.list_(pa.int64()), pa.list_(pa.float64())
    shape = pa.schema(
        [("tree", pa.int64()), ("size", pa.int64()), ("feature", numbers), ("split", reals), ("near", numbers), ("depth", reals)]
    )
    dealt = rows.select("doc_id", *textstats.COUNTS, F.explode(by_chance.cast("array<bigint>")).alias("tree"))
    made = dealt.groupBy("tree").applyInArrow(
        grow, "tree bigint, size bigint, feature array<bigint>, split array<double>, near array<bigint>, depth array<double>"
    )
    grown = sorted(made.collect(), key=lambda r: r["tree"])  # trees of bounded depth
    trees = [(np.array(r["feature"]), np.array(r["split"]), np.array(r["near"]), np.array(r["depth"])) for r in grown]
    return IsolationForest.of(trees, float(np.mean([r["size"] for r in grown])), limit)


def score_histogram(rows: DataFrame, forest: IsolationForest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the score, how many rows that pass the base rules lie there, and whether they are clean: one entry per cell and label."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            counts = _counts(batch)
            cells = np.floor(shared.value.scores(textstats.letter_rates(counts)) * CELLS).astype(np.int64)
            kept = pa.array(~base_failed(counts))
            yield pa.RecordBatch.from_arrays([pa.array(cells).filter(kept), batch.column("quality").filter(kept)], ["cell", "quality"])

    scored = rows.mapInArrow(score, "cell bigint, quality int")
    found = scored.groupBy("cell", (F.col("quality") == 1).alias("clean")).agg(F.count(F.lit(1)).alias("n")).collect()  # two per cell at most
    return np.array([r["cell"] for r in found], float), np.array([r["n"] for r in found], np.int64), np.array([r["clean"] for r in found], bool)


def calibrated(scores: np.ndarray, clean: np.ndarray, max_clean_loss: float, counts: np.ndarray | None = None, between: bool = True) -> float:
    """Score from which a document is rejected: most right verdicts among those losing few enough clean rows.

    ``counts`` are numbers of rows with that score and label, one each without it. The threshold lies ``between`` two scores, or at one.
    """
    if clean.all() or not len(scores):
        return 1.0
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    order = np.argsort(-scores, kind="stable")
    lost, caught = np.cumsum((clean * counts)[order]), np.cumsum((~clean * counts)[order])
    ends = np.append(scores[order][1:] < scores[order][:-1], True)  # equal scores are rejected together
    allowed = ends & (lost <= max_clean_loss * max(1, (clean * counts).sum()))
    gain = np.where(allowed, caught - lost, 0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return 1.0
    below = scores[order][best + 1] if between and best + 1 < len(order) else scores[order][best]
    return float((scores[order][best] + below) / 2)


def quality_rules(docs: DataFrame, model: Model) -> DataFrame:
    """Verdict on every document.

    Returns one row per input row: doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words,
    base_failed, kept, and anomaly (the forest's score). Null texts have no words and fail the base rules; a null
    doc_id stays null; repeated rows get equal results; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # trees of bounded depth: a fixed size

    def judge(batches):
        for batch in small(batches):
            counts = textstats.count_columns(batch.column("text"))
            failed, scores = base_failed(counts), shared.value.scores(counts)
            columns = [batch.column("doc_id")] + [pa.array(counts[name], pa.int64()) for name in BASE]
            columns += [pa.array(failed), pa.array(~failed & (scores < shared.value.threshold)), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    schema = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return narrow(docs).select("doc_id", "text").mapInArrow(judge, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, fit(docs, labels(spark, sf_dir)))


def accuracy_on(results: pd.DataFrame, marks: pd.DataFrame) -> dict[str, float]:
    """Shares of label-1 rows kept and of label-0 rows rejected."""
    both = results.merge(marks, on="doc_id")
    return {"clean_kept": both.kept[both.quality == 1].mean(), "junk_caught": 1 - both.kept[both.quality == 0].mean()}


QUERIES = [Query("op8_quality_rules", op8_quality_rules)]
