"""Small numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 4) -> Column:
    """Round for presentation; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def nan_to_null(value: Column) -> Column:
    """Spark keeps NaN apart from NULL; every operator after the scan works on NULL only."""
    return F.when(~F.isnan(value), value)


def guarded(numerator: Column, denominator: Column) -> Column:
    """Division where a denominator of exactly zero counts as one."""
    return numerator / F.when(denominator == 0, F.lit(1.0)).otherwise(denominator)
