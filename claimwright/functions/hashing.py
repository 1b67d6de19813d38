"""Deterministic splits: a row's fold depends on its key alone, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the multiplicative hash.
MULTIPLIER = 2654435761
MODULUS = 4294967296
KEY_RANGE = 2147483648  # keys are folded below this, so the product fits a BIGINT


def key_hash(key: Column) -> Column:
    low, high = F.pmod(key, F.lit(KEY_RANGE)), F.pmod(F.shiftright(key, 31), F.lit(KEY_RANGE))
    folded = F.pmod(low + high, F.lit(KEY_RANGE))
    return (folded * F.lit(MULTIPLIER)) % F.lit(MODULUS)


def fold_of(key: Column, folds: int = 5) -> Column:
    return (key_hash(key) % folds).cast("int")


def inner_fold_of(key: Column, folds: int = 5) -> Column:
    """A second, independent fold number, for folds inside a training split."""
    return (F.floor(key_hash(key) / folds) % folds).cast("int")
