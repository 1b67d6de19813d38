"""Linear models from sufficient statistics.

One aggregation gives, per group and fold, the row count, the means and the co-moments of
the features and the target (``covar_pop`` merges partial results without cancellation).
A model, and each of its leave-one-fold-out versions, is then a small solve over those
few rows; no raw row ever reaches Python and no fold needs its own pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.session import settle

ALL_FOLDS = -1


def _moments(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    names = [*features, target]
    means = F.array(*[F.avg(c) for c in names])
    pairs = F.array(*[F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), means.alias("means"), pairs.alias("cov")
    )


def _merge(parts: list[tuple[float, np.ndarray, np.ndarray]]):
    """Pool (n, means, covariance) triples."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    shift = [p[1] - mean for p in parts]
    cov = sum(p[0] * (p[2] + np.outer(d, d)) for p, d in zip(parts, shift)) / n
    return n, mean, cov


def _solve(n: float, mean: np.ndarray, cov: np.ndarray, l2: float) -> tuple[float, list[float]]:
    """Ridge solution; ``l2`` penalises the sum of squares as in ||y-Xb||² + l2·||b||².
    A direction without variance gets a zero coefficient."""
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    if len(xy) == 0:
        return float(mean[-1]), []
    lhs = xx + np.eye(len(xy)) * (l2 / n)
    scale = np.sqrt(np.where(np.diag(lhs) > 0, np.diag(lhs), 1.0))
    slopes = np.linalg.pinv(lhs / np.outer(scale, scale), rcond=1e-10) @ (xy / scale) / scale
    return float(mean[-1] - slopes @ mean[:-1]), [float(b) for b in slopes]


@dataclass
class LinearModels:
    """Coefficients per group (and fold): ``group…, fold, n, mean_y, intercept, slopes``."""

    table: DataFrame
    features: list[str]
    keys: list[str]

    def only(self):
        """The fitted numbers of the one model without keys."""
        if self.keys:
            raise ValueError("models by key stay in their table")
        return self.table.where(F.col("fold") == ALL_FOLDS).first()

    def predict(self, df: DataFrame, output: str, out_of_fold: bool = False) -> DataFrame:
        """Add the prediction of each row's own group (NULL where that has no model).
        With ``out_of_fold`` the model that did not see the row's fold is used."""
        names = {"intercept": f"{output}_b0", "slopes": f"{output}_b"}
        table = self.table if out_of_fold else self.table.where(F.col("fold") == ALL_FOLDS)
        on = [*self.keys, "fold"] if out_of_fold else self.keys
        small = table.select(*on, *[F.col(c).alias(n) for c, n in names.items()])
        if on:
            joined = df.join(small, on, "left")
        else:
            b0, b = small.first()
            joined = df.withColumns({names["intercept"]: F.lit(b0), names["slopes"]: F.lit(b)})
        value = linear_value(F.col(names["intercept"]), F.col(names["slopes"]), self.features)
        return joined.withColumn(output, value).drop(*names.values())


def linear_value(intercept: Column, slopes: Column, features: Sequence[str]) -> Column:
    return sum((slopes[i] * F.col(c) for i, c in enumerate(features)), start=intercept)


def fit_linear(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str] = (),
    fold: str | None = None,
    l2: float = 0.0,
) -> LinearModels:
    """Fit one model per combination of ``keys`` (none: one model), and with ``fold`` also
    one for each fold left out. No features: the group's mean."""
    features, keys = list(features), list(keys)
    fold_column = F.col(fold) if fold else F.lit(0)
    moments = _moments(df.withColumn("fold", fold_column), features, target, [*keys, "fold"])
    size = len(features) + 1

    def square(upper) -> np.ndarray:
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = upper
        return full + np.triu(full, 1).T

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {
            int(row.fold): (row.n, np.array(row.means), square(row.cov)) for row in pdf.itertuples()
        }
        chosen = {ALL_FOLDS: list(parts.values())}
        if fold:
            for left_out in parts:
                chosen[left_out] = [p for f, p in parts.items() if f != left_out]
        out = []
        for number, group in chosen.items():
            if group:
                n, mean, cov = _merge(group)
                intercept, slopes = _solve(n, mean, cov, l2)
                out.append((number, n, float(mean[-1]), intercept, slopes))
        result = pd.DataFrame(out, columns=["fold", "n", "mean_y", "intercept", "slopes"])
        for i, k in enumerate(keys):
            result.insert(i, k, pdf[k].iloc[0])
        return result

    kinds = dict(df.dtypes)
    schema = ", ".join(
        [f"`{k}` {kinds[k]}" for k in keys]
        + ["fold int", "n double", "mean_y double", "intercept double", "slopes array<double>"]
    )
    # A group is at most one row per fold here, whatever the table's size.
    solved = moments.groupBy(*keys).applyInPandas(solve, schema)
    return LinearModels(settle(solved, "linear-models"), features, keys)
