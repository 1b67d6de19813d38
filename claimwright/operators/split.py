"""Holdout and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.hashing import fold_of
from claimwright.functions.quantiles import quantile_values


def holdout(key: Column, folds: int = 5) -> Column:
    """``test`` for about one row in ``folds``, by key hash."""
    return F.when(fold_of(key, folds) == 0, F.lit("test")).otherwise(F.lit("train"))


def contiguous_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Equal blocks in key order. The cut points are exact quantiles of the key, so no
    task ever sees the whole key range, which a global row number would force."""
    probs = [i / folds for i in range(1, folds)]
    cuts = sorted(quantile_values(df, [key], probs).values())
    fold = F.lit(0)
    for i, cut in enumerate(cuts, start=1):
        fold = F.when(F.col(key) > cut, F.lit(i)).otherwise(fold)
    return df.withColumn("fold", fold)
