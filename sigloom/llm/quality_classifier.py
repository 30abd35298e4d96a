"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are labelled rows of quality 1; the unlabelled sample is drawn from all rows, with their labels
ignored, and stands for the web. With the class
prior p estimated from the training labels, the risk is p * R(positive as 1) + max(0, R(unlabelled as 0)
- p * R(positive as 0)), minimised over a small network on statistics of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import textstats
from sigloom.llm.common import Query, crc_bucket, documents, keep_rows, labels, narrow
from sigloom.llm.textops import buffers, small


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit (rows of either sample), network and optimiser."""

    positive_rows: int = 4000
    unlabelled_rows: int = 4000
    hidden: int = 16
    steps: int = 400
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.3
    folds: int = 5
    seed: int = 11


def features(column: pa.Array) -> np.ndarray:
    """Rates and byte shares of whole texts; an empty text gets zeros."""
    counts = textstats.count_columns(column)
    data, at = buffers(column)
    return np.hstack([np.sqrt(textstats.rates(counts)), np.sqrt(textstats.byte_shares(data, at))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    """Standardisation and weights of the network, and the estimated class prior."""

    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(rows), self.prior)
        first, bias, second, last = self.weights
        hidden = np.tanh(np.clip((rows - self.centre) / self.scale, -8, 8) @ first + bias)
        return _sigmoid(hidden @ second + last)


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, settings: Settings) -> Model:
    """Adam on the non-negative unbiased logistic risk; whole samples in every step.

    Where the estimated risk of the negatives falls below zero, the step goes up its gradient instead, so that
    the network unlearns what only the positives' memorisation explains.
    """
    both = np.vstack([positive, unlabelled])
    centre, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    xp, xu = (np.clip((x - centre) / scale, -8, 8) for x in (positive, unlabelled))
    rng = np.random.default_rng(settings.seed)
    weights = [
        rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], settings.hidden)), np.zeros(settings.hidden),
        rng.normal(0, 1 / np.sqrt(settings.hidden), settings.hidden), np.zeros(1),
    ]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]

    def gradient(x, hidden, pull):
        """Gradient of the weights when the risk pulls on each row's output by ``pull``."""
        back = pull[:, None] * weights[2] * (1 - hidden**2)
        return [x.T @ back, back.sum(axis=0), hidden.T @ pull, np.array([pull.sum()])]

    for step in range(1, settings.steps + 1):
        hp, hu = np.tanh(xp @ weights[0] + weights[1]), np.tanh(xu @ weights[0] + weights[1])
        gp, gu = hp @ weights[2] + weights[3], hu @ weights[2] + weights[3]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_negative = [
            u - p for u, p in zip(gradient(xu, hu, _sigmoid(gu) / len(xu)), gradient(xp, hp, prior * _sigmoid(gp) / len(xp)))
        ]
        if negative < 0:
            slope = [-g for g in of_negative]
        else:
            of_positive = gradient(xp, hp, prior * (_sigmoid(gp) - 1) / len(xp))
            slope = [a + b for a, b in zip(of_positive, of_negative)]
        for k, g in enumerate(slope):
            g = g + settings.decay * weights[k]
            mean, square = moments[k]
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            rate = settings.rate * (1 - step / (settings.steps + 1))
            weights[k] = weights[k] - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(centre, scale, tuple(weights), prior)


def training_rows(docs: DataFrame, marks: DataFrame, settings: Settings) -> tuple[DataFrame, float]:
    """Bounded samples of trusted positives (positive = 1) and of all rows whatever their labels (0); the class prior.

    A labelled row may be in both. Rows of the held-out fold give nothing: neither labels nor texts.
    """
    fold = crc_bucket(F.col("doc_id").cast("bigint"), settings.folds) != 0
    known = (
        marks.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(fold & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    prior = known.agg(F.avg("quality")).first()[0]
    order = [F.xxhash64("doc_id", F.lit(settings.seed)), F.col("doc_id")]
    positives = known.where("quality = 1").orderBy(*order).limit(settings.positive_rows).select("doc_id", F.lit(1).alias("positive"))
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where(fold & F.col("doc_id").isNotNull())
    # an order of its own, so that the positives' sample does not decide which rows are drawn
    apart = [F.xxhash64("doc_id", F.lit("unlabelled"), F.lit(settings.seed)), F.col("doc_id")]
    unlabelled = every.orderBy(*apart).limit(settings.unlabelled_rows).select("doc_id", F.lit(0).alias("positive"))
    # at most positive_rows + unlabelled_rows ids
    chosen = F.broadcast(positives.unionByName(unlabelled))
    found = narrow(docs).join(chosen, "doc_id").select("doc_id", "positive", "text")
    return found, 0.5 if prior is None else float(prior)


def fit(docs: DataFrame, marks: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from the bounded samples; without positives or unlabelled rows, scores are the prior."""
    rows, prior = training_rows(docs, marks, settings)

    def featured(batches):
        for batch in small(batches):
            made = features(batch.column("text"))
            cells = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), cells], ["doc_id", "positive", "features"])

    got = rows.mapInArrow(featured, "doc_id bigint, positive int, features array<double>").toPandas()
    got = got.sort_values(["doc_id", "positive"], kind="stable")
    sides = [np.array(got.features[got.positive == side].tolist()) for side in (1, 0)]
    if not all(len(x) for x in sides):
        return Model(np.zeros(0), np.ones(0), (), prior)
    return minimise(*sides, prior, settings)


def quality_scores(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """Score of every document: doc_id, held_out, score, predicted, row.

    One row per input row. A null text counts as empty and gets a score too; a null doc_id stays null and counts as the empty
    text for the fold; repeated rows get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def score(batches):
        for batch in small(batches):
            found = shared.value.scores(features(batch.column("text")))
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, "score"])

    scored = narrow(docs).mapInArrow(score, "doc_id bigint, row bigint, score double")
    return scored.select(
        "doc_id", (crc_bucket(F.col("doc_id"), settings.folds) == 0).alias("held_out"), "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"), "row",
    )


def accepted(docs: DataFrame, marks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score reaches the threshold."""
    scores = quality_scores(docs, fit(docs, marks, settings), settings)
    return keep_rows(docs, scores.where("predicted = 1"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, fit(docs, labels(spark, sf_dir))).drop("row")


QUERIES = [Query("op10_quality_classifier", op10_quality_classifier)]
