"""Voting, out-of-fold stacking and meta-features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.operators.boosting import Growth, TreeModel, out_of_fold_models
from claimwright.operators.linear import ALL_FOLDS, LinearModels, fit_linear, linear_value
from claimwright.session import settle


@dataclass
class LinearBase:
    """A base learner of a stack: a mean (no features) or least squares per group."""

    name: str
    features: Sequence[str] = ()
    keys: Sequence[str] = ()


def fit_bases(train: DataFrame, bases: Sequence[LinearBase], fold: str, target: str = "y") -> dict[str, LinearModels]:
    """Each base on all training rows and on every fold complement, in one pass per base."""
    return {b.name: fit_linear(train, b.features, target, b.keys, fold) for b in bases}


def base_predictions(
    df: DataFrame, models: Mapping[str, LinearModels], out_of_fold: bool
) -> DataFrame:
    """Add ``pred_<base>``; a row whose group has no model gets 0."""
    for name, fitted in models.items():
        df = fitted.predict(df, f"pred_{name}", out_of_fold)
    return df.na.fill(0.0, [f"pred_{n}" for n in models])


def linear_stack(
    train: DataFrame,
    test: DataFrame,
    bases: Sequence[LinearBase],
    fold: str,
    l2: float,
    target: str = "y",
) -> tuple[DataFrame, LinearModels]:
    """Ridge over out-of-fold base predictions; bases refitted on all rows for ``test``."""
    models = fit_bases(train.withColumn("fold", F.col(fold)), bases, "fold", target)
    inside = base_predictions(train.withColumn("fold", F.col(fold)), models, True)
    names = [f"pred_{b.name}" for b in bases]
    meta = fit_linear(inside, names, target, l2=l2)
    return meta.predict(base_predictions(test, models, False), "prediction"), meta


def vote_weights(df: DataFrame, predictions: Sequence[str], actual: str = "y") -> dict[str, float]:
    """R² per prediction column on validation rows, negative ones as 0, scaled to sum 1."""
    row = df.agg(
        *[
            (
                F.lit(1.0)
                - F.sum((F.col(actual) - F.col(p)) ** 2)
                / F.nullif(F.var_pop(actual) * F.count(F.lit(1)), F.lit(0.0))
            ).alias(p)
            for p in predictions
        ]
    ).first()
    quality = {p: max(row[p] or 0.0, 0.0) for p in predictions}
    total = sum(quality.values())
    return {p: q / total if total else 1.0 / len(quality) for p, q in quality.items()}


def weighted_vote(weights: Mapping[str, float]) -> Column:
    return sum((F.lit(w) * F.col(p) for p, w in weights.items()), start=F.lit(0.0))


def mean_vote(predictions: Sequence[str]) -> Column:
    return sum((F.col(p) for p in predictions), start=F.lit(0.0)) / F.lit(float(len(predictions)))


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over the columns that are not NULL."""
    filled = F.filter(F.array(*columns), lambda x: x.isNotNull())
    total = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(filled) > 0, total / F.size(filled))


def with_fallback(prediction: Column, segment_mean: Column, global_mean: float | None) -> Column:
    """A prediction, else the segment's mean, else the overall mean, else 0."""
    return F.coalesce(prediction, segment_mean, F.lit(global_mean), F.lit(0.0))


def clip_nonnegative(prediction: Column) -> Column:
    return F.greatest(prediction, F.lit(0.0))


def fitted_groups(models: LinearModels, key: str) -> list[str]:
    """Names of the groups that have a model, in order; they become columns."""
    return sorted(r[0] for r in models.table.select(key).distinct().collect())


def meta_features_wide(
    df: DataFrame, models: LinearModels, segment: str, names: Sequence[str], fold: str
) -> DataFrame:
    """``pred_<s>`` of a row's own segment (NULL elsewhere), ``all_pred_<s>`` of every
    segment's model, both row means, and ``segment_prediction``.

    The coefficients are pivoted to one row per fold, so that every model reaches every
    row by a join on the fold number instead of rows times models. ``fold`` is NULL for
    rows outside the training data, which get the models fitted on all of it.
    """
    wide = settle(
        models.table.groupBy("fold")
        .pivot(segment, list(names))
        .agg(F.first(F.struct("intercept", "slopes"))),
        "meta-coefficients",
    ).select(F.col("fold").alias("model_fold"), *[F.col(f"`{s}`").alias(f"coef_{s}") for s in names])
    joined = df.withColumn("model_fold", F.coalesce(F.col(fold), F.lit(ALL_FOLDS))).join(
        wide, "model_fold"
    )
    values = {
        f"all_pred_{s}": linear_value(
            F.col(f"coef_{s}")["intercept"], F.col(f"coef_{s}")["slopes"], models.features
        )
        for s in names
    }
    joined = joined.withColumns(values).drop("model_fold", *[f"coef_{s}" for s in names])
    own = {f"pred_{s}": F.when(F.col(segment) == s, F.col(f"all_pred_{s}")) for s in names}
    return joined.withColumns(own).withColumns(
        {
            "pred_mean": row_mean(list(own)),
            "all_pred_mean": row_mean(list(values)),
            "segment_prediction": F.coalesce(*[F.col(c) for c in own]),
        }
    )


def tree_out_of_fold(
    train: DataFrame,
    test: DataFrame | None,
    features: Sequence[str],
    bases: Mapping[str, Growth],
    fold: str,
    folds: int = 5,
    key: str | None = None,
) -> tuple[DataFrame, DataFrame | None, dict[str, TreeModel]]:
    """Out-of-fold ``pred_<base>`` columns on ``train`` and full-fit ones on ``test``.

    All fits, those without one fold and those on all rows, grow side by side over one set
    of blocks. The result is written once and shared by all meta-learners.
    """

    def scored(df, number):
        for name in bases:
            df = fitted[number, name].transform(df, f"pred_{name}")
        return df

    fitted = out_of_fold_models(train, features, bases, fold, folds, key=key)
    inside = scored(train.where(F.col(fold) == 0), 0)
    for k in range(1, folds):
        inside = inside.unionByName(scored(train.where(F.col(fold) == k), k))
    full = {n: fitted[folds, n] for n in bases}
    outside = settle(scored(test, folds), "stack-test") if test is not None else None
    return settle(inside, "stack-train"), outside, full
