"""Search for the segmentation that predicts best, with the segment mean as the model.

All candidate columns (or pairs) are unpivoted into one ``(candidate, value)`` table, so a
search is two scans whatever the number of candidates: one for the dictionary of counts
and training means, one for the errors against it.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.operators.metrics import metric_columns, weighted_metrics
from claimwright.operators.segments import LEFTOVER
from claimwright.session import settle


def _unpivoted(df: DataFrame, candidates: Mapping[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in candidates.items()]
    return df.select("y", "split", F.explode(F.array(*cells)).alias("c")).select(
        "y", "split", F.col("c.name").alias("candidate"), "c.value"
    )


def evaluate_candidates(
    df: DataFrame, candidates: Mapping[str, Column], min_size: int, most_values: int | None
) -> DataFrame:
    """Weighted test metrics per candidate. ``df`` has ``y`` and ``split``.

    A candidate with more than ``most_values`` values, or with one segment only, is left
    out. Weights are whole segment sizes, metrics those of the test rows.
    """
    long = _unpivoted(df, candidates)
    train = F.when(F.col("split") == "train", F.col("y"))
    values = settle(
        long.groupBy("candidate", "value").agg(
            F.count(F.lit(1)).alias("n"), F.count(train).alias("n_train"), F.sum(train).alias("s_train")
        ),
        "search-values",
    )
    large = F.col("value").isNotNull() & (F.col("n") >= min_size)
    labelled = values.withColumn("segment", F.when(large, F.col("value")).otherwise(LEFTOVER))
    segments = (
        labelled.groupBy("candidate", "segment")
        .agg(
            F.sum("n").alias("n_total"),
            (F.sum("s_train") / F.nullif(F.sum("n_train"), F.lit(0))).alias("mean_y"),
        )
        .where(F.col("n_total") >= min_size)
    )
    usable = (
        labelled.groupBy("candidate")
        .agg(F.count("value").alias("n_values"))
        .join(segments.groupBy("candidate").agg(F.count("segment").alias("n_segments")), "candidate")
        .where("n_segments > 1")
    )
    if most_values is not None:
        usable = usable.where(F.col("n_values") <= most_values)
    dictionary = settle(
        labelled.select("candidate", "value", "segment")
        .join(segments, ["candidate", "segment"])
        .join(usable.select("candidate"), "candidate", "left_semi"),
        "search-dictionary",
    )
    scored = long.where("split = 'test'").join(
        dictionary,
        (long["candidate"] == dictionary["candidate"]) & long["value"].eqNullSafe(dictionary["value"]),
    )
    per_segment = scored.groupBy(dictionary["candidate"], "segment", "n_total").agg(
        *metric_columns(F.col("y"), F.col("mean_y"))
    )
    return weighted_metrics(per_segment, "n_total", ["candidate"])


def pair_candidates(columns: list[str]) -> dict[str, Column]:
    return {
        f"{a} + {b}": F.concat_ws(
            " & ", F.concat(F.lit(f"{a}="), F.col(a)), F.concat(F.lit(f"{b}="), F.col(b))
        )
        for a, b in combinations(columns, 2)
    }


def top_candidates(results: DataFrame, k: int = 5) -> DataFrame:
    return results.orderBy(F.col("r2").desc_nulls_last(), "candidate").limit(k)
