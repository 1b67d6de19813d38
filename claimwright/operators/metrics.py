"""Evaluation: metrics from row-level predictions, and tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["mse", "rmse", "mae", "r2"]


def metric_columns(actual: Column, predicted: Column) -> list[Column]:
    """R² is 1 - SSE/SST with SST from ``var_pop`` (mergeable and stable); a constant
    target has none."""
    error = actual - predicted
    sst = F.var_pop(actual) * F.count(F.lit(1))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.sum(error * error) / F.nullif(sst, F.lit(0.0))).alias("r2"),
    ]


def regression_metrics(
    df: DataFrame, keys: Sequence[str] = (), actual: str = "y", predicted: str = "prediction"
) -> DataFrame:
    return df.groupBy(*keys).agg(*metric_columns(F.col(actual), F.col(predicted)))


def weighted_metrics(
    metrics: DataFrame, size: str, keys: Sequence[str] = (), names: Sequence[str] = ("rmse", "mae", "r2")
) -> DataFrame:
    """Size-weighted means over segments: the mean of the RMSEs, not a pooled RMSE."""
    return metrics.groupBy(*keys).agg(
        *[
            (F.sum(F.col(m) * F.col(size)) / F.sum(F.when(F.col(m).isNotNull(), F.col(size)))).alias(m)
            for m in names
        ],
        F.sum(size).alias("n_total"),
    )


def improvement_pct(value: Column, base: Column, lower_is_better: bool = False) -> Column:
    gain = (base - value) if lower_is_better else (value - base)
    return gain / F.nullif(base, F.lit(0.0)) * 100


def recommendation_tier(gain: Column) -> Column:
    return (
        F.when(gain > 5, F.lit("substantial"))
        .when(gain > 2, F.lit("moderate"))
        .otherwise(F.lit("minimal"))
    )


def against_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Gains over one model's row. ``metrics`` has one row per model, so the baseline is
    a single fitted row and enters as a scalar subquery."""
    base = metrics.where(F.col("model") == baseline).select(F.struct("r2", "rmse").alias("b"))
    return (
        metrics.withColumn("b", base.scalar())
        .withColumn("r2_gain_pct", improvement_pct(F.col("r2"), F.col("b.r2")))
        .withColumn("rmse_gain_pct", improvement_pct(F.col("rmse"), F.col("b.rmse"), True))
        .drop("b")
    )


def comparison_pivot(metrics: DataFrame, models: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Metrics as rows, models as columns."""
    return (
        metrics.unpivot("model", list(names), "metric", "value")
        .groupBy("metric")
        .pivot("model", list(models))
        .agg(F.first("value"))
    )
