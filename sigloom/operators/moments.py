"""Count, mean and scatter of vectors per key, in one aggregation; models that need nothing else are made from them.

Parts are merged by their means, so nothing large cancels. Moments of separate folds merge into those of any training set: one
scan serves all folds of a cross-validation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.vectors import CELLS_PER_PANEL, dense_rows

#: cells that a task holds before it gives out what it has
HELD = 4_000_000
_SCHEMA = "key string, n double, cells binary"


@dataclass(frozen=True)
class Moments:
    """``scatter`` is the sum of the outer products of the deviations from ``mean``."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        off = rows - mean
        return Moments(float(len(rows)), mean, off.T @ off)

    def merged(self, other: Moments) -> Moments:
        n, step = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, self.mean + step * (other.n / n), scatter)

    def turned(self, axes: np.ndarray) -> Moments:
        """Moments of the rows times a matrix."""
        return Moments(self.n, self.mean @ axes, axes.T @ self.scatter @ axes)

    def variance(self) -> np.ndarray:
        return np.maximum(np.diag(self.scatter), 0.0) / self.n

    def gram(self) -> np.ndarray:
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def packed(self) -> bytes:
        """Mean and upper triangle."""
        return np.concatenate([self.mean, self.scatter[np.triu_indices(len(self.mean))]]).tobytes()

    @staticmethod
    def unpacked(n: float, raw: bytes, width: int) -> Moments:
        cells = np.frombuffer(raw)
        scatter = np.zeros((width, width))
        scatter[np.triu_indices(width)] = cells[width:]
        return Moments(n, cells[:width].copy(), scatter + np.triu(scatter, 1).T)


def merge_all(parts: Iterable[Moments]) -> Moments:
    total = None
    for part in parts:
        total = part if total is None else total.merged(part)
    if total is None:
        raise ValueError("no rows")
    return total


def grouped_moments(rows: DataFrame, column: str, keys: Sequence[str], width: int) -> dict[tuple, Moments]:
    """Moments of a vector column per value of integer ``keys``, combined in tasks and again before each key's parts meet.

    What reaches the driver is a triangle of ``width`` rows per key, the size of a model with a covariance per key.
    """

    def batch(key: str, m: Moments) -> pa.RecordBatch:
        columns = [pa.array([key]), pa.array([m.n]), pa.array([m.packed()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Moments] = {}
        step = max(1, CELLS_PER_PANEL // max(width, 1))
        for part in batches:
            names = np.array(part.column("key").to_pylist(), object)
            for at in range(0, part.num_rows, step):
                x, own = dense_rows(part.column("v").slice(at, step), width), names[at : at + step]
                for key in sorted(set(own)):
                    found = Moments.of(x[own == key])
                    held[key] = held[key].merged(found) if key in held else found
                    if len(held) * width * width > HELD:
                        yield from (batch(k, m) for k, m in held.items())
                        held.clear()
        yield from (batch(k, m) for k, m in held.items())

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (
            Moments.unpacked(n, raw, width) for b in batches for n, raw in zip(b.column("n").to_pylist(), b.column("cells").to_pylist())
        )
        yield batch(key[0].as_py(), merge_all(parts))

    named = rows.select(F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("key"), F.unwrap_udt(column).alias("v"))
    parts = named.mapInArrow(run, _SCHEMA)
    for salts in (16, 1):
        by = [F.col("key"), F.pmod(F.xxhash64("cells"), F.lit(salts)).alias("salt")] if salts > 1 else [F.col("key")]
        parts = parts.groupBy(*by).applyInArrow(merge, _SCHEMA)
    return {
        tuple(int(k) for k in r["key"].split(",")): Moments.unpacked(r["n"], r["cells"], width) for r in parts.toLocalIterator()
    }


RANK_CUT = 1e-10


def whitening(covariance: np.ndarray) -> tuple[np.ndarray, float]:
    """Matrix that whitens a covariance on its range, and the log of its determinant there."""
    values, vectors = np.linalg.eigh(covariance)
    values = np.maximum(values, RANK_CUT * max(values.max(), 1e-300))
    return vectors / np.sqrt(values), float(np.log(values).sum())


def lda_parts(classes: Sequence[Moments]) -> dict[str, np.ndarray]:
    """Weights and bias of a linear discriminant with a common covariance."""
    sizes, means = np.array([m.n for m in classes]), np.array([m.mean for m in classes])
    n = sizes.sum()
    if n <= len(classes):
        raise ValueError("the number of samples must exceed the number of classes")
    values, vectors = np.linalg.eigh(sum(m.scatter for m in classes) / (n - len(classes)))
    keep = values > RANK_CUT * max(values.max(), 1e-300)
    weights = means @ (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    return {"weights": weights, "bias": np.log(sizes / n) - 0.5 * (weights * means).sum(axis=1)}


def _densities(classes: Sequence[Moments], covariances: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
    total = sum(m.n for m in classes)
    found = [whitening(c) for c in covariances]
    offsets = [np.log(m.n / total) - 0.5 * log_det for m, (_, log_det) in zip(classes, found)]
    return {"means": np.array([m.mean for m in classes]), "whitening": np.array([w.ravel() for w, _ in found]), "offsets": np.array(offsets)}


def qda_parts(classes: Sequence[Moments]) -> dict[str, np.ndarray]:
    """Densities with a covariance for each class."""
    if any(m.n < 2 for m in classes):
        raise ValueError("every class needs two samples to have a covariance")
    return _densities(classes, [m.scatter / (m.n - 1) for m in classes])


def bayes_parts(classes: Sequence[Moments]) -> dict[str, np.ndarray]:
    """Densities of independent features; every variance is raised by a billionth of the largest one."""
    raised = 1e-9 * merge_all(classes).variance().max()
    spreads = [m.variance() + raised for m in classes]
    total = sum(m.n for m in classes)
    offsets = [np.log(m.n / total) - 0.5 * np.log(s).sum() for m, s in zip(classes, spreads)]
    return {"means": np.array([m.mean for m in classes]), "scales": 1 / np.sqrt(np.array(spreads)), "offsets": np.array(offsets)}


def centroid_parts(classes: Sequence[Moments]) -> dict[str, np.ndarray]:
    return {"centroids": np.array([m.mean for m in classes])}


def scaling(total: Moments) -> np.ndarray:
    """One over each feature's standard deviation; features without variance keep their value."""
    spread = np.sqrt(total.variance())
    return np.where(spread > 0, 1.0 / np.where(spread > 0, spread, 1.0), 1.0)


def leading_axes(total: Moments, components: int) -> np.ndarray:
    """Leading right singular vectors of the uncentered rows; directions beyond the rank are zero."""
    values, vectors = np.linalg.eigh(total.gram())
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return vectors * (values > 1e-14 * max(values.max(), 1e-300))
