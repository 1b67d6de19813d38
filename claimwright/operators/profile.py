"""Profiling: each profile is one or two aggregations with map-side partial results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_profile(df: DataFrame) -> DataFrame:
    """``(column_name, n_missing)`` of the columns that have a NULL or NaN."""
    kinds = dict(df.dtypes)

    def missing(name):
        null = F.col(name).isNull()
        return null | F.isnan(name) if kinds[name] in ("double", "float") else null

    counts = df.agg(*[F.count_if(missing(c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_missing").where("n_missing > 0")


def cardinality_profile(df: DataFrame, columns: Sequence[str], most: int = 20) -> DataFrame:
    """Distinct values per column, and whether there are too many to segment by it."""
    return (
        df.select(*columns)
        .unpivot([], list(columns), "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
        .withColumn("too_many", F.col("n_distinct") > most)
    )


def table_shape(df: DataFrame, steps: dict[str, F.Column], n_columns: int | None = None) -> DataFrame:
    """Rows left after each filter: ``steps`` maps a label to its condition, applied in turn.
    ``n_columns``: of the whole table, where ``df`` has only those that the steps need."""
    aggregates, condition = [], F.lit(True)
    for label, step in steps.items():
        condition = condition & F.coalesce(step, F.lit(False))
        aggregates.append(F.count_if(condition).alias(label))
    return (
        df.agg(*aggregates)
        .unpivot([], list(steps), "step", "n_rows")
        .withColumn("n_columns", F.lit(n_columns or len(df.columns)).cast("long"))
    )


def target_histogram(df: DataFrame, segment: str, target: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between each segment's smallest and largest target, last bin closed."""
    from claimwright.session import settle

    ranges = settle(
        df.groupBy(segment).agg(F.min(target).alias("low"), F.max(target).alias("high")),
        "histogram-ranges",
    )
    width = F.col("high") - F.col("low")
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.floor((F.col(target) - F.col("low")) * bins / F.when(width != 0, width))
    )
    return (
        df.select(segment, target)
        .join(ranges, segment)
        .withColumn("bin", F.least(slot, F.lit(bins - 1)).cast("int"))
        .groupBy(segment, "bin", "low", "high")
        .agg(F.count(F.lit(1)).alias("n"))
    )
