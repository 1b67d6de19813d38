"""Exact quantiles with linear interpolation, without gathering a column in one task.

The built-in ``percentile`` merges every distinct value of a group into one reducer. Here
one pass of ``percentile_approx`` (a sketch of bounded size, with a guaranteed rank error)
gives a bracket around each wanted rank. While a bracket could hold more than ``LARGEST``
rows, another sketch of the rows inside narrows it. A last pass counts the rows below the
bracket and the distinct values inside it, pre-aggregated on the map side; only those few
distinct values are put in order. Hot values collapse to one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimwright.session import settle

ACCURACY = 20_000
MARGIN = 8.0 / ACCURACY  # eight times the rank error the sketch guarantees
GRID = 256  # cells of a further narrowing
LARGEST = 5_000_000  # values of one bracket that a task puts in order


def _brackets(long: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """One row per key, feature and probability: row count and value bracket."""
    grid = []
    for p in probs:
        grid += [max(p - MARGIN, 0.0), min(p + MARGIN, 1.0)]
    stats = long.groupBy(*keys, "feature").agg(
        F.count("value").alias("n"),
        F.min("value").alias("smallest"),
        F.max("value").alias("largest"),
        F.percentile_approx("value", grid, ACCURACY).alias("q"),
    )
    # A short column is taken whole: there the margin is less than a few ranks.
    short = F.col("n") * MARGIN < 4
    cells = []
    for i, p in enumerate(probs):
        low = F.when(short, F.col("smallest")).otherwise(F.col("q")[2 * i])
        high = F.when(short, F.col("largest")).otherwise(F.col("q")[2 * i + 1])
        cells.append(F.struct(F.lit(float(p)).alias("p"), low.alias("low"), high.alias("high")))
    return (
        stats.select(*keys, "feature", "n", F.explode(F.array(*cells)).alias("cell"))
        .select(*keys, "feature", "n", "cell.*")
    )


def _position() -> Column:
    return F.col("p") * (F.col("n") - 1)


def _narrowed(long: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Tighter brackets: a grid of approximate quantiles of the rows inside, of which the
    wanted rank's cell and one whole cell on either side are kept."""
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    stats = (
        long.join(brackets, [*keys, "feature"])
        .where(F.col("value") <= F.col("high"))
        .groupBy(*keys, "feature", "n", "p", "low", "high")
        .agg(
            F.count_if(F.col("value") < F.col("low")).alias("below"),
            F.count(inside).alias("m"),
            F.percentile_approx(inside, [i / GRID for i in range(1, GRID)], ACCURACY).alias("q"),
        )
    )
    cell = F.floor((_position() - F.col("below")) / F.col("m") * GRID).cast("int")
    enough = F.col("m") >= 16 * GRID
    low = F.when(enough & (cell >= 2), F.get("q", cell - 2))
    high = F.when(enough & (cell <= GRID - 3), F.get("q", cell + 1))
    return stats.select(
        *keys, "feature", "n", "p",
        F.coalesce(low, F.col("low")).alias("low"), F.coalesce(high, F.col("high")).alias("high"),
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(keys…, feature, p, n, value)``; NULLs are skipped, NaN must be gone before."""
    keys = list(keys)
    long = (
        df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(keys, list(columns), "feature", "value")
        .where(F.col("value").isNotNull())
    )
    brackets = settle(_brackets(long, keys, probs), "quantile-brackets")
    widest = (brackets.agg(F.max("n")).first()[0] or 0) * 2 * MARGIN
    while widest > LARGEST:
        brackets = settle(_narrowed(long, brackets, keys), "quantile-brackets")
        widest *= 4.0 / GRID
    inside = (
        long.join(brackets, [*keys, "feature"])
        .where(F.col("value") <= F.col("high"))
        .withColumn("value", F.when(F.col("value") >= F.col("low"), F.col("value")))
        .groupBy(*keys, "feature", "p", "n", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    ordered = W.partitionBy(*keys, "feature", "p").orderBy(F.col("value").asc_nulls_first())
    position = _position()
    first = F.floor(position)
    second = F.least(first + 1, F.col("n") - 1)
    before = F.col("upto") - F.col("copies")

    def at(rank):
        return F.max(F.when((before <= rank) & (rank < F.col("upto")), F.col("value")))

    return (
        inside.withColumn("upto", F.sum("copies").over(ordered))
        .groupBy(*keys, "feature", "p", "n")
        .agg(at(first).alias("v0"), at(second).alias("v1"))
        .select(
            *keys,
            "feature",
            "p",
            "n",
            (F.col("v0") + (position - first) * (F.col("v1") - F.col("v0"))).alias("value"),
        )
    )


def quantile_values(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[tuple[str, float], float]:
    """The quantiles of whole columns as fitted numbers (columns x probabilities of them).

    As literals they are pushed into the scan, which a joined one-row table would not be.
    """
    rows = exact_quantiles(df, columns, probs).collect()
    return {(r["feature"], r["p"]): r["value"] for r in rows}
