"""Support-vector regression with a radial kernel over sampled landmarks.

The kernel machine minimises ``|w|^2 / 2 + C * sum(max(0, |y - f(x)| - epsilon))``. Here its
functions are those spanned by kernels at ``landmarks`` rows (Nyström features), so that ``w``
has a bounded size. The loss is minimised by reweighted least squares: rows outside the
tube pull with weight ``C / (|r| - epsilon)`` towards its near edge, rows inside not at all. A
pass adds up one weighted normal matrix by ``treeAggregate`` and the driver solves it; the
features of a row are made from it anew in every pass, so nothing large is kept. With many rows
the passes start from the weights that about ``WARM_ROWS`` of them give, drawn by hash; the
objective is convex, so the passes over all rows, which go on until their own loss stands still,
end at the same weights, only sooner.

Missing values count as the feature's mean. With fewer rows than landmarks the model is the
exact kernel machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.operators.models import SEED

#: Rows that give the start, and rows of a block.
WARM_ROWS, BLOCK_ROWS = 1 << 16, 1 << 16


def scale_gamma(df: DataFrame, columns: Sequence[str]) -> float:
    """1 / (number of features x variance over all of their values)."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.avg(F.col(c) ** 2).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    means = np.array([row[f"m{i}"] for i in range(len(columns))], float)
    squares = np.array([row[f"s{i}"] for i in range(len(columns))], float)
    variance = squares.mean() - means.mean() ** 2
    return 1.0 / (len(columns) * variance) if variance > 0 else 1.0


@dataclass
class RadialModel:
    columns: list[str]
    means: np.ndarray
    gamma: float
    landmarks: np.ndarray
    root: np.ndarray  # from kernels at the landmarks to features of unit metric
    weights: np.ndarray  # the last one is the constant

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.means, x)
        apart = (x * x).sum(1)[:, None] + (self.landmarks * self.landmarks).sum(1)[None, :] - 2.0 * (x @ self.landmarks.T)
        return np.concatenate([np.exp(-self.gamma * np.maximum(apart, 0.0)) @ self.root, np.ones((len(x), 1))], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.predict(np.stack([c.to_numpy(float) for c in columns], 1)))

        return df.withColumn(output, F.pandas_udf(score, "double")(*[F.col(c).cast("double") for c in self.columns]))


def fit_rbf(
    train: DataFrame, columns: Sequence[str], target: str = "y", cost: float = 1.0, epsilon: float = 0.1,
    gamma: float | None = None, landmarks: int = 256, passes: int = 60, tolerance: float = 1e-5,
) -> RadialModel:
    """Fit on all rows of ``train``; ``gamma`` is that of ``scale_gamma`` unless given."""
    columns = list(columns)
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    rows = train.select(F.col(target).cast("double").alias("target"), *numbers)
    gamma = scale_gamma(rows, columns) if gamma is None else gamma
    first = rows.agg(F.count("*").alias("n"), F.avg("target").alias("y"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    means = np.array([first[f"m{k}"] or 0.0 for k in range(len(columns))])
    # The rows with the least hashes: the same sample however the rows are dealt.
    chosen = rows.select(*columns).distinct().orderBy(F.xxhash64(*columns, F.lit(SEED)), *columns).limit(landmarks).collect()
    at = np.array([[np.nan if v is None else v for v in r] for r in chosen], float).reshape(len(chosen), len(columns))
    at = np.where(np.isnan(at), means, at)
    apart = ((at[:, None, :] - at[None, :, :]) ** 2).sum(2) if len(at) else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(np.exp(-gamma * apart)) if len(at) else (np.zeros(0), np.zeros((0, 0)))
    sound = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    root = vectors[:, sound] / np.sqrt(values[sound])
    size = root.shape[1] + 1
    start = np.zeros(size)
    start[-1] = first["y"] or 0.0
    model = RadialModel(columns, means, gamma, at, root, start)
    if not first["n"]:
        return model
    share = first["n"] // WARM_ROWS
    if share >= 4:
        some = rows.where(F.pmod(F.xxhash64("target", *columns, F.lit(SEED)), F.lit(share)) == 0)
        model.weights = _descend(some, model, cost * share, epsilon, passes, tolerance)
    model.weights = _descend(rows, model, cost, epsilon, passes, tolerance)
    return model


def _descend(rows: DataFrame, model: RadialModel, cost: float, epsilon: float, passes: int, tolerance: float) -> np.ndarray:
    """The weights of the least loss on ``rows``, from those of the model on."""
    columns, size = rows.columns, len(model.weights)
    blocks = rows.mapInArrow(_blocks, "block binary").rdd.map(lambda r: np.frombuffer(r["block"]).reshape(-1, len(columns))).persist()
    best, best_loss = model.weights, np.inf
    try:
        for _ in range(passes):
            weights = model.weights
            matrix, side, loss = blocks.mapPartitions(lambda part: [_sums(part, model, cost, epsilon)]).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
            loss += float(weights[:-1] @ weights[:-1]) / 2
            if loss < best_loss * (1 - tolerance):
                best, best_loss = weights, loss
            elif loss >= best_loss:
                # Overshot: back half of the way to the best so far, or done when that is near.
                step = (weights + best) / 2
                if np.linalg.norm(step - best) <= 1e-6 * max(1.0, np.linalg.norm(best)):
                    break
                model.weights = step
                continue
            else:
                best = weights
                break
            ridge = np.eye(size)
            ridge[-1, -1] = 1e-9 * max(matrix[-1, -1], 1.0)
            model.weights = np.linalg.solve(matrix + ridge, side)
    finally:
        blocks.unpersist()
    return best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as bytes, up to about ``BLOCK_ROWS`` in one; missing values are NaN."""
    held: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1))
        if sum(map(len, held)) >= BLOCK_ROWS:
            yield emit()
            held.clear()
    if held:
        yield emit()


def _sums(part: Iterator[np.ndarray], model: RadialModel, cost: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted normal equations and loss at the model's weights."""
    size = len(model.weights)
    matrix, side, loss = np.zeros((size, size)), np.zeros(size), 0.0
    for block in part:
        for low in range(0, len(block), 8192):
            y, phi = block[low : low + 8192, 0], model.features(block[low : low + 8192, 1:])
            rest = y - phi @ model.weights
            out = np.abs(rest) - epsilon
            loss += cost * out[out > 0].sum()
            pull = np.where(out > 0, cost / np.maximum(out, 1e-3 * max(epsilon, 1e-9) + 1e-9), 0.0)
            edge = y - np.sign(rest) * epsilon
            pulled = phi * np.sqrt(pull)[:, None]
            matrix += pulled.T @ pulled  # of one array: half of the products
            side += phi.T @ (pull * edge)
    return matrix, side, loss
