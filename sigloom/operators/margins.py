"""Linear one-versus-rest models, and random feature maps of the radial and polynomial kernels."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasRegParam, HasSeed, HasTol
from pyspark.sql import functions as F

from sigloom.operators.models import KERNELS, MatrixModel
from sigloom.operators.vectors import CELLS_PER_PANEL, dense_rows
from sigloom.session import dealt


class OneVsRestLinear(Estimator, HasInputCol, HasLabelCol, HasOutputCol, HasMaxIter, HasRegParam, HasTol):
    """One linear model per class, all of them fitted in the same passes over the rows.

    Minimises the mean loss plus ``regParam / 2 |w|^2`` without a penalty on the intercept. A pass evaluates every
    class's next step at once and is one aggregation, so the number of jobs does not grow with the classes.
    ``loss`` is ``hinge`` (scores are margins) or ``logistic`` (class probabilities: sigmoids, normalised).
    ``through`` is a feature map to fit first: it is applied to some rows at a time in every pass, so that wide features are
    never stored or sent, and the model has both as its stages.
    """

    loss = Param(Params._dummy(), "loss", "hinge or logistic", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, inputCol=None, labelCol="label", outputCol="scores", loss="hinge", regParam=0.0, maxIter=100, tol=1e-3, through=None
    ):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="scores", loss="hinge", regParam=0.0, maxIter=100, tol=1e-3)
        self.through = through
        self._set(**{k: v for k, v in self._input_kwargs.items() if k != "through"})

    def _fit(self, dataset):
        column, label = self.getInputCol(), self.getLabelCol()
        logistic = self.getOrDefault(self.loss) == "logistic"
        width = dataset.select(column).first()[0].size
        classes = int(dataset.agg(F.max(label)).first()[0]) + 1
        rows = dataset.select(F.unwrap_udt(column).alias("v"), F.col(label).cast("int").alias("y"))
        n = rows.count()
        mapped = None if self.through is None else self.through.fit(dataset)
        source = Rows(width) if mapped is None else Rows(width, KERNELS[mapped.getOrDefault("kernel")], mapped.parts)
        width = source.mapped_width()
        tasks = -(-n * width // CELLS_PER_TASK)
        # every pass starts a task per partition: small tables get few
        rows = dealt(rows, tasks).persist(StorageLevel.MEMORY_AND_DISK)

        def evaluate(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return _loss_sums(rows, weights, source, logistic, n, self.getRegParam(), tasks)

        def along(weights: np.ndarray, direction: np.ndarray, steps: np.ndarray) -> np.ndarray:
            return _loss_along(rows, weights, direction, steps, source, logistic, n, self.getRegParam(), tasks)

        weights = minimise_all(evaluate, along, np.zeros((classes, width + 1)), self.getMaxIter(), self.getTol())
        rows.unpersist()
        model = MatrixModel(
            inputCol=column if mapped is None else mapped.getOutputCol(), outputCol=self.getOutputCol(),
            kernel="logistic_probability" if logistic else "linear",
            width=int(width), parts={"weights": weights[:, :-1], "bias": weights[:, -1]},
        )
        return model if mapped is None else PipelineModel(stages=[mapped, model])


@dataclass(frozen=True)
class Rows:
    """How rows of ``width`` entries are read: as they are, or through a feature map with its matrices."""

    width: int
    kernel: Callable | None = None
    parts: dict | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        return x if self.kernel is None else self.kernel(x, self.parts)

    def mapped_width(self) -> int:
        return self.features(np.zeros((1, self.width))).shape[1]


def _panels(batches, source: Rows, width: int, classes: int):
    """Rows as dense panels of ``width`` features, with +1 for their class and -1 for the others."""
    cells = CELLS_PER_PANEL if source.kernel is None else CELLS_PER_MAP
    step = max(1, cells // max(width, source.width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            y = batch.column("y").to_numpy()[at : at + step]
            x = source.features(dense_rows(batch.column("v").slice(at, step), source.width))
            yield x, np.where(y[:, None] == np.arange(classes), 1.0, -1.0)


def _losses(margin: np.ndarray, logistic: bool) -> np.ndarray:
    return np.logaddexp(0, -margin) if logistic else np.maximum(1 - margin, 0)


def _added(rows, kernel, sent: np.ndarray, shape: tuple[int, ...], tasks: int) -> np.ndarray:
    """Sum over all tasks of the array that ``kernel(batches, sent)`` makes of a task's rows."""
    shared = rows.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        cells = kernel(batches, shared.value).ravel().tolist()
        yield pa.RecordBatch.from_arrays([pa.array([cells], pa.list_(pa.float64()))], ["cells"])

    parts, total = rows.mapInArrow(run, "cells array<double>"), np.zeros(shape)
    if tasks > MANY_PARTS:  # sums of many tasks are added up on the cluster
        cells = parts.select(F.posexplode("cells").alias("at", "cell")).groupBy("at").agg(F.sum("cell").alias("cell"))
        for r in cells.collect():
            total.flat[r["at"]] = r["cell"]
    else:
        for r in parts.collect():
            total += np.reshape(r["cells"], shape)
    shared.destroy()
    return total


def _loss_sums(rows, weights, source, logistic, n, penalty, tasks) -> tuple[np.ndarray, np.ndarray]:
    """Objective and gradient of every class at its row of ``weights`` (the intercept last)."""

    def kernel(batches, w):
        total = np.zeros((len(w), w.shape[1] + 1))
        for x, side in _panels(batches, source, w.shape[1] - 1, len(w)):
            margin = side * (x @ w[:, :-1].T + w[:, -1])
            pull = -side * (0.5 * (1 - np.tanh(0.5 * margin)) if logistic else margin < 1)
            total[:, -1] += _losses(margin, logistic).sum(axis=0)
            total[:, :-2] += pull.T @ x
            total[:, -2] += pull.sum(axis=0)
        return total

    total = _added(rows, kernel, weights, (len(weights), weights.shape[1] + 1), tasks) / max(n, 1)
    inner = weights[:, :-1]
    total[:, :-2] += penalty * inner
    return total[:, -1] + penalty / 2 * (inner * inner).sum(axis=1), total[:, :-1]


def _loss_along(rows, weights, direction, steps, source, logistic, n, penalty, tasks) -> np.ndarray:
    """Objective of every class after each of its ``steps`` along its direction.

    Margins change linearly along a line, so a pass needs two products whatever the number of steps.
    """

    def kernel(batches, sent):
        w, d = sent
        total = np.zeros(steps.shape)
        for x, side in _panels(batches, source, w.shape[1] - 1, len(w)):
            margin, change = (side * (x @ a[:, :-1].T + a[:, -1]) for a in (w, d))
            for t in range(steps.shape[1]):
                total[:, t] += _losses(margin + steps[:, t] * change, logistic).sum(axis=0)
        return total

    total = _added(rows, kernel, np.stack([weights, direction]), steps.shape, tasks) / max(n, 1)
    moved = weights[:, None, :-1] + steps[:, :, None] * direction[:, None, :-1]
    return total + penalty / 2 * (moved * moved).sum(axis=2)


CELLS_PER_TASK = 500_000
#: features that a feature map makes at a time
CELLS_PER_MAP = 500_000
MANY_PARTS = 64
MEMORY = 10
#: factors of a first guess at the step length that one pass tries
STEPS = 2.0 ** np.arange(-12, 11)


def minimise_all(evaluate, along, weights: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Limited-memory BFGS for several separate objectives that are evaluated together.

    ``evaluate`` maps all rows of weights to their values and gradients, ``along`` gives the values after several steps along a
    direction. A step takes two passes: one looks for the best length on the line, over all of ``STEPS`` at once, and one
    evaluates there. Every row has its own history; one that gains less than ``tol`` of its value in three steps in a row, or finds no
    descent, stays where it is.
    """
    value, slope = evaluate(weights)
    rows = range(len(weights))
    history: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in rows]
    open_, idle = set(rows), np.zeros(len(weights), int)
    for _ in range(max_iter):
        if not open_:
            break
        direction = np.zeros_like(weights)
        for k in open_:
            direction[k] = _descent(slope[k], history[k])
            if direction[k] @ slope[k] >= 0:
                history[k].clear()
                direction[k] = -slope[k]
        guess = np.array([1.0 if history[k] else 1.0 / max(1e-12, float(np.linalg.norm(slope[k]))) for k in rows])
        steps = guess[:, None] * STEPS
        found = along(weights, direction, steps)
        best = steps[rows, found.argmin(axis=1)]
        gains = found.min(axis=1) < value
        moved = weights + np.where(gains, best, 0.0)[:, None] * direction
        now, gradient = evaluate(moved)
        for k in sorted(open_):
            if not gains[k]:
                if history[k]:
                    history[k].clear()  # once more along the gradient
                else:
                    open_.discard(k)
                continue
            s, y = moved[k] - weights[k], gradient[k] - slope[k]
            if s @ y > 1e-10 * (y @ y):
                history[k] = [*history[k][1 - MEMORY :], (s, y)]
            idle[k] = idle[k] + 1 if value[k] - now[k] <= tol * max(abs(float(now[k])), 1e-12) else 0
            weights[k], value[k], slope[k] = moved[k], now[k], gradient[k]
            if idle[k] >= 3:
                open_.discard(k)
    return weights


def _descent(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop recursion over the last steps and gradient changes."""
    q, used = gradient.copy(), []
    for s, y in reversed(history):
        a = (s @ q) / (s @ y)
        used.append(a)
        q -= a * y
    if history:
        s, y = history[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(history, reversed(used)):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


class FourierFeatures(Estimator, HasInputCol, HasOutputCol, HasSeed):
    """Random cosine features whose inner products approximate ``exp(-gamma |x - y|^2)``.

    ``gamma`` is one over the input width.
    """

    size = Param(Params._dummy(), "size", "number of cosine features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=256, seed=0):
        super().__init__()
        self._setDefault(size=256, seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        width = dataset.select(self.getInputCol()).first()[0].size
        size = self.getOrDefault(self.size)
        random = np.random.default_rng(self.getSeed())
        axes = random.normal(scale=np.sqrt(2.0 / width), size=(width, size))
        phase = random.uniform(0, 2 * np.pi, size)
        return MatrixModel(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), kernel="fourier", width=int(width),
            parts={"axes": axes, "phase": phase},
        )


class PolynomialSketch(Estimator, HasInputCol, HasOutputCol, HasSeed):
    """Features whose inner products approximate ``(gamma x.y) ** degree`` without a constant term.

    ``gamma`` is one over the input width. The number of features is the same at every width; its inverse root
    is the relative error of a kernel value. Where fewer products of entries exist than features, they are added up
    one by one, and features that no product meets, which are zero, are left out.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    degree = Param(Params._dummy(), "degree", "degree of the kernel", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=1024, degree=2, seed=0):
        super().__init__()
        self._setDefault(size=1024, degree=2, seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        width = dataset.select(self.getInputCol()).first()[0].size
        size, degree = self.getOrDefault(self.size), self.getOrDefault(self.degree)
        random = np.random.default_rng(self.getSeed())
        buckets, signs = random.integers(0, size, (degree, width)), random.choice([-1.0, 1.0], (degree, width))
        few = width**degree <= size
        if few:
            parts = product_parts(buckets, signs, size, 1.0 / width)
        else:
            parts = {"buckets": buckets, "signs": signs, "size": np.array([size]), "gamma": np.array([1.0 / width])}
        return MatrixModel(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), kernel="tensor_products" if few else "tensor_sketch",
            width=int(width), parts=parts,
        )


def product_parts(buckets: np.ndarray, signs: np.ndarray, size: int, gamma: float) -> dict[str, np.ndarray]:
    """Parts of ``tensor_products``: entries of every product, its sign, and where each feature's products start, by feature."""
    degree, width = buckets.shape
    entries = np.array(list(itertools.product(range(width), repeat=degree))).reshape(-1, degree)
    each = np.arange(degree)
    target, sign = buckets[each, entries].sum(axis=1) % size, signs[each, entries].prod(axis=1)
    order = np.argsort(target, kind="stable")
    starts = np.flatnonzero(np.diff(target[order], prepend=-1))
    return {"entries": entries[order].T, "signs": sign[order], "starts": starts, "gamma": np.array([gamma])}
