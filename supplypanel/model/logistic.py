"""Logistic regression by Newton's method, with a proof of convergence.

The rows are read once and kept on the executors' disks as blocks of arrays, each array in the fewest bytes; a step is
one short job over these, without a plan. A task sums its part of the loss, the gradient and the
Gram matrix of each model, p × p numbers whatever its rows; Spark adds them up,
and the driver solves a system of that size. Several models, say one for each
window of years, take their steps in the same jobs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplypanel.model.preparation import Preparation, design_of

#: Largest entry of the mean loss's gradient at which a fit is done, and above which it has failed.
DONE, FAILED = 1e-12, 1e-9
MAX_STEPS = 60
#: Tasks of which the driver adds the sums up itself.
SENDING_TASKS = 16


@dataclass(frozen=True)
class LogisticFit:
    """Weights with what proves them: rows, steps taken, and the gradient's largest entry (of the mean penalised loss)."""

    coefficients: list[float]
    intercept: float
    n: int
    steps: int
    gradient_norm: float


def _blocks(rows: DataFrame, features: list[str]) -> RDD:
    """The rows as blocks of arrays: a list of the features' values, label and year, each array in the fewest bytes that hold its numbers."""

    def narrow(values: np.ndarray) -> np.ndarray:
        if not len(values) or not np.isfinite(values).all() or (values != np.rint(values)).any():
            with np.errstate(over="ignore"):
                short = values.astype(np.float32)
            return short if ((short == values) | np.isnan(values)).all() else values
        most = np.abs(values).max()
        return values.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32) if most < 1 << 31 else values

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, label, year = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            block = pickle.dumps(([narrow(c) for c in columns], narrow(label), year), pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    plain = rows.select(
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col("deteriorated").cast("double").alias("_label"), F.col("reference_year").cast("int").alias("_year"),
    )
    return plain.mapInArrow(packed, "block binary").rdd.map(lambda row: pickle.loads(row.block))


def _sums(blocks: RDD, features: list[str], parts: list[tuple]) -> dict[int, np.ndarray]:
    """The summed loss, count, gradient and Gram matrix of each model, end to end, from one reading of the blocks.

    ``parts`` has for each model its number, preparation steps, weights with the
    intercept last, and its years (None for all).
    """
    plans = [(number, design_of(steps), weights, years) for number, steps, weights, years in parts]

    def of_block(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = x @ weights[:-1] + weights[-1]
        p = np.exp(-np.logaddexp(0.0, -z))
        loss = np.logaddexp(0.0, z) - y * z
        curve = p * (1 - p)
        weighted, size = x.T * curve, len(weights)
        gram = np.empty((size, size))
        gram[:-1, :-1] = weighted @ x
        gram[:-1, -1] = gram[-1, :-1] = weighted.sum(axis=1)
        gram[-1, -1] = curve.sum()
        return np.concatenate([[loss.sum(), len(y)], x.T @ (p - y), [(p - y).sum()], gram.ravel()])

    def summed(blocks: Iterator[tuple]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for columns, label, year in blocks:
            columns, label = [c.astype(float) for c in columns], label.astype(float)
            for number, design, weights, years in plans:
                inside = np.ones(len(label), bool) if years is None else np.isin(year, years)
                chosen = slice(None) if inside.all() else inside
                if not inside.any():
                    continue
                x = design({name: c[chosen] for name, c in zip(features, columns)})
                found = of_block(x, label[chosen], weights)
                sums[number] = sums[number] + found if number in sums else found
        yield sums

    def added(a: dict, b: dict) -> dict:
        return {number: a.get(number, 0.0) + b.get(number, 0.0) for number in a.keys() | b.keys()}

    # (p + 1)² + p + 3 numbers for each model and task; many tasks add them up among themselves first.
    found = blocks.mapPartitions(summed)
    return found.reduce(added) if found.getNumPartitions() <= SENDING_TASKS else found.treeReduce(added)


def fit_logistic(
    rows: DataFrame, models: list[tuple[Preparation, list[int] | None]], c: float = 1.0
) -> list[LogisticFit]:
    """Fits one model for each pair of preparation and years, by the summed loss plus ``|w|² / (2 c)``.

    The intercept bears no penalty. ``rows`` has the features, ``deteriorated`` and
    ``reference_year``, and is read once for all steps. A step that does not lower
    the loss is halved. Raises if a model has no rows or its gradient does not vanish.
    """
    features = list(dict.fromkeys(name for preparation, _ in models for name, *_ in preparation.steps()))
    blocks = _blocks(rows, features).persist(StorageLevel.DISK_ONLY)
    try:
        return _newton(blocks, features, models, c)
    finally:
        blocks.unpersist()


def _newton(blocks: RDD, features: list[str], models: list[tuple[Preparation, list[int] | None]], c: float) -> list[LogisticFit]:
    """Newton's steps of all models over the same blocks."""
    steps = [preparation.steps() for preparation, _ in models]
    at = [np.zeros(len(s) + 1) for s in steps]
    tried = [w.copy() for w in at]
    move = [np.zeros(len(s) + 1) for s in steps]
    best = [np.inf] * len(models)
    done: dict[int, LogisticFit] = {}
    for step in range(1, MAX_STEPS + 1):
        open_ = [i for i in range(len(models)) if i not in done]
        sums = _sums(blocks, features, [(i, steps[i], tried[i], models[i][1]) for i in open_])
        for i in open_:
            if i not in sums or sums[i][1] == 0:
                raise ValueError("a model without rows")
            size = len(at[i])
            penalty = np.append(np.full(size - 1, 1.0 / c), 0.0)
            loss = sums[i][0] + 0.5 * float(penalty @ tried[i] ** 2)
            n = sums[i][1]
            gradient = sums[i][2 : 2 + size] + penalty * tried[i]
            norm = float(np.abs(gradient).max() / n)
            if loss > best[i] * (1 + 1e-12) and norm > DONE:
                move[i] = move[i] / 2
                tried[i] = at[i] + move[i]
                continue
            best[i], at[i] = loss, tried[i]
            curve = sums[i][2 + size :].reshape(size, size) + np.diag(penalty)
            move[i] = -np.linalg.solve(curve, gradient)
            tried[i] = at[i] + move[i]
            tiny = np.abs(move[i]).max() <= 1e-14 * max(1.0, np.abs(at[i]).max())  # doubles go no further
            if norm <= DONE or (tiny and norm <= FAILED):
                done[i] = LogisticFit(at[i][:-1].tolist(), float(at[i][-1]), int(n), step, norm)
        if len(done) == len(models):
            return [done[i] for i in range(len(models))]
    raise RuntimeError(f"{len(models) - len(done)} of {len(models)} logistic fits did not converge in {MAX_STEPS} steps")
