"""The common start of most queries: a written claims table, cleaned and with features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.functions.hashing import fold_of, inner_fold_of
from claimwright.operators.clean import constant_impute, fit_medians, impute, quantile_trim
from claimwright.operators.features import engineered, sources
from claimwright.operators.segments import SegmentDictionary, segment_hierarchical
from claimwright.operators.split import holdout
from claimwright.session import settle
from claimwright.sources.claims import CATEGORICAL, COLUMNS, KEY, NUMERIC, TARGET, claims


def written_claims(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Key, target and the given claims columns (all by default), written once, so that the
    passes over them do not repeat the joins they need."""
    wanted = COLUMNS if columns is None else [c for c in COLUMNS if c in {KEY, TARGET, *columns}]
    return settle(claims(spark, sf_dir, wanted), "claims")


def base(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Trimmed, imputed and engineered claims with ``y``, ``fold`` and ``split``.

    With ``columns`` only those, derived or not, and what they come from are read, joined,
    written and imputed. Threshold and medians are literals, so this stays one projection
    over a Parquet scan, with the target filter pushed down and unused columns pruned.
    """
    needed = sources(columns) if columns else COLUMNS
    kept = quantile_trim(written_claims(spark, sf_dir, needed), TARGET)
    medians = fit_medians(kept, [c for c in NUMERIC if c in needed])
    filled = constant_impute(impute(kept, medians), [c for c in CATEGORICAL if c in needed])
    return engineered(filled).withColumns(
        {
            "y": F.col(TARGET),
            "fold": fold_of(F.col(KEY)),
            "inner_fold": inner_fold_of(F.col(KEY)),
            "split": holdout(F.col(KEY)),
        }
    )


def hierarchy(df: DataFrame) -> SegmentDictionary:
    return segment_hierarchical(df, "exceptional_circumstances", "accident_type")


CRITERIA = ("exceptional_circumstances", "accident_type")


def segmented(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``base`` with the two-level ``segment``; rows of no segment are left out."""
    frame = base(spark, sf_dir, *CRITERIA, *columns)
    return hierarchy(frame).split(frame)
