"""Segmentation with a minimum size and a leftover bucket.

All rules run on the *dictionary*: one row per distinct value (or combination) with its
row count, which is a map-side combined aggregation. The rows get their segment by one
join on the raw columns. No window ever runs over the rows, so a value that holds a third
of the table does not land in one task.

The leftover bucket has its own key, so a real category called "Other" is not confused
with it; ``shown`` turns the key into the label people read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.session import settle

LEFTOVER = "__other__"


@dataclass
class SegmentDictionary:
    """``table`` has the columns, ``segment`` and ``n`` (rows of that combination)."""

    table: DataFrame
    columns: list[str]
    fallback: str | None
    """Segment of a combination that is not in the table; None drops such rows."""

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``segment`` by a join on the columns (no re-parsing of segment names)."""
        joined = df.join(self.table.select(*self.columns, "segment"), self.columns, "left")
        return joined.withColumn("segment", F.coalesce(F.col("segment"), F.lit(self.fallback)))

    def split(self, df: DataFrame) -> DataFrame:
        """As ``assign``, without the rows that belong to no segment."""
        return self.assign(df).where(F.col("segment").isNotNull())

    def sizes(self) -> DataFrame:
        return (
            self.table.where(F.col("segment").isNotNull())
            .groupBy("segment")
            .agg(F.sum("n").alias("n"))
        )


def shown(segment: Column) -> Column:
    return F.when(segment == LEFTOVER, F.lit("Other")).otherwise(segment)


def _counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return settle(counts, "segment-counts")


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def _finish(
    labelled: DataFrame, columns: Sequence[str], min_size: int, merge_small: bool
) -> SegmentDictionary:
    """``labelled`` has ``segment`` = NULL for leftovers. Keep the leftover bucket when it
    reaches the minimum; else drop it, or merge it into the largest segment."""
    summary = (
        labelled.groupBy("segment")
        .agg(F.sum("n").alias("n"))
        .agg(
            F.sum(F.when(F.col("segment").isNull(), F.col("n"))).alias("left"),
            F.min_by(
                "segment",
                F.when(
                    F.col("segment").isNotNull(),
                    F.struct((-F.col("n")).alias("size"), F.col("segment").alias("name")),
                ),
            ).alias("largest"),
        )
        .first()
    )
    left, fallback = summary["left"] or 0, None
    if left >= min_size:
        fallback = LEFTOVER
    elif merge_small:
        fallback = summary["largest"]
    table = labelled.withColumn("segment", F.coalesce(F.col("segment"), F.lit(fallback)))
    return SegmentDictionary(table.select(*columns, "segment", "n"), list(columns), fallback)


def segment_single(df: DataFrame, column: str, min_size: int = 50) -> SegmentDictionary:
    """Each value with enough rows is a segment; the rest form the leftover bucket."""
    counts = _counts(df, [column])
    label = F.when(F.col("n") >= min_size, F.col(column))
    return _finish(counts.withColumn("segment", label), [column], min_size, False)


def segment_multi(df: DataFrame, columns: Sequence[str], min_size: int = 100) -> SegmentDictionary:
    """Segments are combinations, labelled ``c1=v1 & c2=v2``."""
    name = F.concat_ws(" & ", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in columns])
    label = F.when(~_any_null(columns) & (F.col("n") >= min_size), name)
    counts = _counts(df, columns)
    return _finish(counts.withColumn("segment", label), columns, min_size, False)


def segment_hierarchical(
    df: DataFrame, primary: str, secondary: str, min_size: int = 50
) -> SegmentDictionary:
    """A primary value with three times the minimum is split by the secondary column; a
    smaller one that still reaches the minimum stays whole."""
    counts = _counts(df, [primary, secondary])
    totals = counts.groupBy(primary).agg(F.sum("n").alias("n_primary"))
    size = F.col("n_primary")
    pair = F.concat_ws("_", F.col(primary), F.col(secondary))
    label = (
        F.when(F.col(primary).isNull() | (size < min_size), F.lit(None))
        .when(size < 3 * min_size, F.col(primary))
        .when(F.col(secondary).isNotNull() & (F.col("n") >= min_size), pair)
    )
    labelled = counts.join(totals, primary, "left").withColumn("segment", label)
    return _finish(labelled, [primary, secondary], min_size, False)


def segment_composite(
    df: DataFrame, columns: Sequence[str], min_size: int = 50
) -> SegmentDictionary:
    """Combinations named ``v1_v2_`` (one column: the bare value); leftovers below the
    minimum go into the largest segment, and the dictionary remembers that, so scoring
    finds the same model."""
    bare = len(columns) == 1
    name = F.col(columns[0]) if bare else F.concat(*[F.concat(F.col(c), F.lit("_")) for c in columns])
    label = F.when(~_any_null(columns) & (F.col("n") >= min_size), name)
    counts = _counts(df, columns)
    return _finish(counts.withColumn("segment", label), columns, min_size, True)


def segment_residual(df: DataFrame, dictionary: SegmentDictionary) -> DataFrame:
    """Rows that are in no segment of their own: an anti-join against the dictionary's
    combinations, not against the segmented rows, so the table is not shuffled by key."""
    own = dictionary.table.where(
        F.col("segment").isNotNull() & (F.col("segment") != F.lit(dictionary.fallback or LEFTOVER))
    )
    return df.join(own.select(*dictionary.columns), dictionary.columns, "left_anti")
