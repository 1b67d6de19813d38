"""Explanation tables for batches of records.

The explained segment model is the mean of one-feature least-squares models, which keeps
one slope per feature and segment. All fitted numbers of a segment sit in one row of a
small table as arrays in feature order; records get them by one join on the segment, and
everything per feature then happens inside the row (``arrays_zip``, higher-order
functions) without a further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimwright.operators.boosting import TreeModel
from claimwright.session import settle

# How many features of each kind a sensitivity report shows first.
QUOTA = {"damage": 2, "injury": 1, "demographic": 1, "other": 1}
REPORT_SIZE = 5
SCORE_DIGITS = 9  # scores are compared at this precision


def kind_of(feature: str) -> str:
    if feature.startswith(("special_", "general_", "total_")):
        return "damage"
    if any(word in feature for word in ("injury", "recovery", "whiplash", "psych")):
        return "injury"
    return "demographic" if feature in ("driver_age", "age", "dependents") else "other"


def fit_segment_models(train: DataFrame, segment: str, features: Sequence[str], target: str) -> DataFrame:
    """Per segment: size, mean target, and per feature the slope, mean and importance
    (absolute correlation, scaled to sum 1), as arrays in feature order.

    The features are exploded into rows before the aggregation: map-side combining makes
    that cheap, while one aggregation over all feature columns at once would generate a
    method too large for the JVM to compile.
    """
    count = float(len(features))
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x"))
            for i, c in enumerate(features)
        ]
    )
    moments = (
        train.select(segment, F.col(target).alias("y"), F.explode(cells).alias("c"))
        .groupBy(segment, F.col("c.i").alias("i"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("y").alias("my"),
            F.avg("c.x").alias("mx"),
            F.var_pop("c.x").alias("vx"),
            F.var_pop("y").alias("vy"),
            F.covar_pop("c.x", "y").alias("vxy"),
        )
    )
    slope = F.when(F.col("vx") > 0, F.col("vxy") / F.when(F.col("vx") > 0, F.col("vx"))).otherwise(0.0)
    spread = F.sqrt(F.col("vx") * F.col("vy"))
    strength = F.when(spread > 0, F.abs(F.col("vxy")) / F.when(spread > 0, spread)).otherwise(0.0)
    item = F.struct("i", slope.alias("b"), strength.alias("s"), F.col("mx").alias("m"))
    ordered = moments.groupBy(segment).agg(
        F.first("n").alias("n"),
        F.first("my").alias("mean_y"),
        F.sort_array(F.collect_list(item)).alias("f"),
    )
    total = F.aggregate("f", F.lit(0.0), lambda a, z: a + z["s"])
    explained = F.aggregate("f", F.lit(0.0), lambda a, z: a + z["b"] * z["m"])
    return settle(
        ordered.select(
            segment,
            "n",
            "mean_y",
            F.transform("f", lambda z: z["b"] / count).alias("slopes"),
            (F.col("mean_y") - explained / count).alias("intercept"),
            F.transform("f", lambda z: z["s"] / F.when(total > 0, total).otherwise(1.0)).alias("importances"),
            F.transform("f", lambda z: z["m"]).alias("means"),
        ),
        "segment-models",
    )


def values_of(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def names_of(features: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in features])


def predicted(features: Sequence[str]) -> Column:
    """Prediction of the record's own segment model (columns of ``fit_segment_models``)."""
    return sum(
        (F.col("slopes")[i] * F.col(c) for i, c in enumerate(features)), start=F.col("intercept")
    )


def importance_table(models: DataFrame, segment: str, features: Sequence[str]) -> DataFrame:
    """Long ``(segment, feature, importance, mean)``; segments times features rows."""
    zipped = F.arrays_zip(
        names_of(features).alias("feature"), F.col("importances"), F.col("means")
    )
    return models.select(segment, F.explode(zipped).alias("z")).select(
        segment, "z.feature", F.col("z.importances").alias("importance"), F.col("z.means").alias("mean")
    )


def selected_features(
    models: DataFrame, segment: str, features: Sequence[str], least: int = 3
) -> DataFrame:
    """Features at or above the segment's mean importance; the top ``least`` if fewer are."""
    table = importance_table(models, segment, features)
    per_segment = W.partitionBy(segment)  # one row per feature
    order = per_segment.orderBy(F.round("importance", SCORE_DIGITS).desc(), "feature")
    high = F.col("importance") >= F.avg("importance").over(per_segment)
    marked = table.withColumn("high", high).withColumns(
        {"place": F.row_number().over(order), "n_high": F.count_if("high").over(per_segment)}
    )
    chosen = F.when(F.col("n_high") >= least, F.col("high")).otherwise(F.col("place") <= least)
    return marked.where(chosen).select(segment, "feature", "importance")


def ranked_features(models: DataFrame, segment: str, features: Sequence[str], top: int) -> DataFrame:
    """Per segment an array ``ranked`` of (feature, importance, mean), most important first."""
    items = F.transform(
        F.arrays_zip(names_of(features).alias("f"), F.col("importances").alias("i"), F.col("means").alias("m")),
        lambda z: F.struct(
            (-F.round(z["i"], SCORE_DIGITS)).alias("order"),
            z["f"].alias("feature"),
            z["i"].alias("importance"),
            z["m"].alias("mean"),
        ),
    )
    return models.withColumn("ranked", F.slice(F.array_sort(items), 1, top))


def contribution_shares(models: DataFrame, least: float = 0.01) -> DataFrame:
    """From ``ranked``: keep importances above ``least`` (all, if none is) and give each its
    share of the kept total and the running share, which are the same for every record."""
    kept = F.filter("ranked", lambda z: z["importance"] > least)
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.col("ranked"))
    total = F.aggregate("kept", F.lit(0.0), lambda a, z: a + z["importance"])
    return models.withColumn("kept", kept).withColumn(
        "shares",
        F.transform(
            "kept",
            lambda z, i: F.struct(
                z["feature"].alias("feature"),
                (z["importance"] / F.when(total > 0, total)).alias("share"),
                (
                    F.aggregate(F.slice("kept", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["importance"])
                    / F.when(total > 0, total)
                ).alias("running"),
            ),
        ),
    )


def test_values(value: Column) -> tuple[Column, Column]:
    """The two test values of a feature: half and one and a half times the value (100 and 1000
    for zero), or 100 either side when these are closer than 1."""
    low = F.when(value == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.1), value * 0.5))
    high = F.when(value == 0, F.lit(1000.0)).otherwise(value * 1.5)
    narrow = F.abs(high - low) < 1.0
    return F.when(narrow, F.greatest(F.lit(0.0), value - 100)).otherwise(low), F.when(narrow, value + 100).otherwise(high)


def test_width(value: Column) -> Column:
    """Distance between the two test values of a feature."""
    usual = F.when(value == 0, F.lit(900.0)).otherwise(value * 1.5 - F.greatest(F.lit(0.1), value * 0.5))
    return F.when(F.abs(usual) < 1.0, value + 100 - F.greatest(F.lit(0.0), value - 100)).otherwise(usual)


def slopes_of_model(df: DataFrame, model: TreeModel, features: Sequence[str]) -> DataFrame:
    """Add ``slopes``: for every feature the change of the model's prediction between the
    record's two test values, over their distance, all else unchanged."""
    pairs = F.transform(values_of(features), lambda v: F.array(*[x.cast("double") for x in test_values(v)]))
    which = F.array(*[F.lit(model.features.index(c)) for c in features])
    tested = df.withColumn("tests", pairs).withColumn("tested", model.what_if(which, F.col("tests")))
    slope = F.zip_with("tests", "tested", lambda t, p: F.coalesce(F.try_divide(p[1] - p[0], t[1] - t[0]), F.lit(0.0)))
    return tested.withColumn("slopes", slope).drop("tests", "tested")


def impact(value: Column, always: Column, slope: Column, importance: Column, prediction: Column):
    """Whether a perturbation moves the prediction by more than 1 or by more than 0.5 %,
    by how much, by which share, and the score. A value near zero counts only if ``always``."""
    change = F.abs(slope * test_width(value))
    share = F.when(prediction > 0, change / F.when(prediction > 0, prediction)).otherwise(0.0)
    moved = (always | (F.abs(value) >= 0.1)) & ((change > 1.0) | (share > 0.005))
    return moved, change, share, share * 0.7 + importance * 0.3


def _facts(features: Sequence[str]) -> Column:
    """One struct per feature from a few short arrays. Spelling the structs out per feature
    would make the generated method too long for the JVM to compile."""
    return F.arrays_zip(
        names_of(features).alias("feature"),
        F.array(*[F.lit(kind_of(c)) for c in features]).alias("kind"),
        F.array(*[F.lit(c.startswith("total_")) for c in features]).alias("always"),
        F.array(*[F.lit(-sorted(features).index(c)) for c in features]).alias("name_order"),
        values_of(features).alias("value"),
        F.col("slopes").alias("slope"),
        F.col("importances").alias("importance"),
    )


def moving(features: Sequence[str]) -> Column:
    """Array of the features that matter for a record, best score first and ties by name, as
    (order, name_order, feature, kind, change, share, score, value, slope)."""

    def measured(z: Column) -> Column:
        moved, change, share, score = impact(z["value"], z["always"], z["slope"], z["importance"], F.col("prediction"))
        return F.when(
            moved,
            F.struct(
                F.round(score, SCORE_DIGITS).alias("order"), z["name_order"].alias("name_order"), z["feature"].alias("feature"), z["kind"].alias("kind"),
                change.alias("change"), share.alias("share"), score.alias("score"), z["value"].alias("value"), z["slope"].alias("slope"),
            ),
        )

    return F.sort_array(F.filter(F.transform(_facts(features), measured), lambda x: x.isNotNull()), asc=False)


def screened(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Rows ``(key, feature, kind, change, share, score)`` of the features that matter.
    ``df`` holds the records, their segment's arrays and ``prediction``."""
    return exploded(df.select(key, moving(features).alias("all")), "all", "m").select(key, "m.feature", "m.kind", "m.change", "m.share", "m.score")


def exploded(df: DataFrame, entries: str, entry: str, at: str = "at") -> DataFrame:
    """A row for each of the ``entries``. The plain form of the generator would add a filter on
    their number below, which evaluates what they are made of once more for every use."""
    return df.select("*", F.posexplode_outer(entries).alias(at, entry)).drop(entries).where(F.col(entry).isNotNull())


def _first_of_kind(ranked: Column, kind: str, count: int) -> Column:
    return F.slice(F.filter(ranked, lambda x: x["kind"] == kind), 1, count)


def with_shown(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``shown``, the record's features for a report as entries of ``moving``: first the
    quota of every kind, then the best of the rest, five in all. All of it stays in the row."""
    ranked = df.withColumn("ranked", moving(features))
    picked = F.concat(*[_first_of_kind(F.col("ranked"), k, n) for k, n in QUOTA.items()])
    return ranked.withColumn("shown", F.slice(F.array_distinct(F.concat(picked, F.col("ranked"))), 1, REPORT_SIZE)).drop("ranked")


def diverse(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``(key, feature, kind, place)`` of ``with_shown``."""
    return exploded(with_shown(df, features).select(key, "shown"), "shown", "s").select(
        key, "s.feature", "s.kind", (F.col("at") + 1).cast("long").alias("place")
    )


def curve_range(value: Column, p10: Column, p90: Column, largest: Column) -> tuple[Column, Column]:
    """20 % to 200 % of a value; for one near zero the segment's P10 to P90, or 0 up to at
    least 1000 when these lie within 1."""
    near_zero = F.abs(value) < 0.1
    low, high = F.greatest(F.lit(0.0), p10), p90
    narrow = high - low < 1.0
    return (
        F.when(~near_zero, F.greatest(F.lit(0.0), value * 0.2)).when(narrow, 0.0).otherwise(low),
        F.when(~near_zero, value * 2.0)
        .when(narrow, F.greatest(F.lit(1000.0), largest * 1.2))
        .otherwise(high),
    )
