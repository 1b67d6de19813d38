"""Row filters, imputation, scaling and encoding.

Fitted parameters (a threshold, medians, means) are plain numbers, one per column, found
on the cluster and used as literals, so that applying them costs no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.quantiles import quantile_values


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull() & ~F.isnan(target))


def finite_target(df: DataFrame, target: str) -> DataFrame:
    return drop_missing_target(df, target).where(F.abs(F.col(target)) < float("inf"))


def trim_threshold(df: DataFrame, target: str, q: float = 0.999) -> float:
    """The target's ``q`` quantile; ``df`` must hold finite targets only."""
    return quantile_values(df, [target], [q])[(target, q)]


def quantile_trim(df: DataFrame, target: str, q: float = 0.999) -> DataFrame:
    kept = finite_target(df, target)
    return kept.where(F.col(target) <= trim_threshold(kept, target, q))


def text_exclude(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    """Drop the hits of a case-insensitive pattern in the first column that has any."""
    regex = f"(?i){pattern}"
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    hits = df.agg(*[F.count_if(F.col(c).rlike(regex)).alias(c) for c in present]).first()
    for column in present:
        if hits[column] > 0:
            return df.where(~F.coalesce(F.col(column).rlike(regex), F.lit(False)))
    return df


def feature_projection(
    df: DataFrame, features: Sequence[str], target: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The wanted features in order; one that the table lacks becomes 0."""
    columns = [F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features]
    return df.select(*keep, *columns, *([target] if target else []))


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; to learn them on a training split only, pass that split."""
    found = quantile_values(df, columns, [0.5]) if columns else {}
    return {c: found[(c, 0.5)] for c in columns if (c, 0.5) in found}


def impute(df: DataFrame, values: dict[str, float | str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}) if values else df


def constant_impute(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    return impute(df, {c: value for c in columns})


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return impute(df, {c: 0.0 for c in columns})


def drop_all_null_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leave out those of ``columns`` that are NULL on every row."""
    filled = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if filled[c] == 0])


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a deviation of zero counts as one."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def scaled(column: str, scaler: dict[str, tuple[float, float]]) -> Column:
    mean, deviation = scaler[column]
    return (F.col(column) - F.lit(mean)) / F.lit(deviation)


def fit_categories(df: DataFrame, column: str) -> list[str]:
    """Distinct values in order, for one indicator column each. For columns of many values
    use ``indicator_vector``, which keeps them in one sparse vector."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def indicator_vector(train: DataFrame, columns: Sequence[str], output: str = "indicators") -> PipelineModel:
    """A fitted encoder of any number of values into one sparse vector; NULL and values not
    seen in ``train`` give zeros."""
    indexed = [f"{c}_index" for c in columns]
    encoded = [f"{c}_vector" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
            VectorAssembler(inputCols=encoded, outputCol=output),
        ]
    ).fit(train)


def one_hot(column: str, categories: Sequence[str]) -> list[Column]:
    """One 0/1 column per category; a value not seen in training gives zeros only."""
    return [
        F.coalesce(F.col(column) == F.lit(c), F.lit(False)).cast("int").alias(f"{column}_{c}")
        for c in categories
    ]
