"""Explanations of the models that predict: boosters per segment, and the unified model.

No SQL states boosters; tests compare these tables with scoring changed rows one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.functions.numbers import rounded
from claimwright.functions.quantiles import exact_quantiles
from claimwright.operators import explain as ex
from claimwright.operators import models as mo
from claimwright.operators import segments as sg
from claimwright.operators.boosting import TreeModel, with_segment_number
from claimwright.operators.clean import finite_target
from claimwright.operators.split import holdout
from claimwright.operators.unified import FittedSegmentedModel, UnifiedSegmentedModel, boosted_per_segment
from claimwright.plans.base import CRITERIA, base, hierarchy, written_claims
from claimwright.plans.explain import FEATURES
from claimwright.plans.registry import query
from claimwright.session import settle, shared_path
from claimwright.sources.claims import KEY, TARGET
from claimwright.streaming.score import score_stream

#: Trees of the explained boosters, as in the unified model.
TREES = 150


def boosted_explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TreeModel]:
    """Segmented records with ``prediction``, ``segment_number`` and their segment's
    ``importances``, ``means`` and ``mean_y``, and the boosters that predict."""
    frame = base(spark, sf_dir, *CRITERIA, *FEATURES)
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    rows = settle(hierarchy(frame).split(frame).select(KEY, "segment", "split", "y", *numbers), "boosted-rows")
    train = rows.where("split = 'train'")
    model = boosted_per_segment(train, FEATURES, mo.boosted_trees(TREES, 0.1, 5, subsample=0.8, column_share=0.8))
    shares = spark.createDataFrame(
        [(s, [float(v) for v in model.importances(k)]) for k, s in enumerate(model.segments)], "segment string, importances array<double>"
    )
    means = train.groupBy("segment").agg(F.array(*[F.avg(c) for c in FEATURES]).alias("means"), F.avg("y").alias("mean_y"))
    fitted = settle(shares.join(means, "segment"), "boosted-segments")
    scored = with_segment_number(rows.join(fitted, "segment"), "segment", model.segments).withColumn("prediction", model.prediction())
    return settle(scored, "boosted-explained"), model


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TreeModel]:
    rows, model = boosted_explained(spark, sf_dir)
    return settle(ex.slopes_of_model(rows, model, FEATURES), "boosted-slopes"), model


@query("sensitivity_screen_boosted")
def sensitivity_screen_boosted(spark, sf_dir) -> DataFrame:
    """Features whose change moves the prediction of the record's own booster."""
    found = ex.screened(_moved(spark, sf_dir)[0], KEY, FEATURES)
    return found.select(KEY, "feature", "kind", rounded(F.col("change")).alias("change"), rounded(F.col("share"), 6).alias("share"), rounded(F.col("score"), 6).alias("score"))


@query("diverse_top_features_boosted")
def diverse_top_features_boosted(spark, sf_dir) -> DataFrame:
    """Features that a report on the booster's prediction shows, by the quota of kinds."""
    return ex.diverse(_moved(spark, sf_dir)[0], KEY, FEATURES)


@query("sensitivity_curve_boosted")
def sensitivity_curve_boosted(spark, sf_dir) -> DataFrame:
    """Eleven values of each shown feature and the booster's prediction at each."""
    rows, model = _moved(spark, sf_dir)
    spread = exact_quantiles(rows, FEATURES, [0.1, 0.9, 1.0], ["segment"])
    at = {"low": 0.1, "high": 0.9, "top": 1.0}
    spread = spread.groupBy("segment", "feature").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in at.items()])
    ranges = settle(spread.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*at)))).alias("ranges")), "boosted-ranges")
    shown = ex.with_shown(rows.join(ranges, "segment"), FEATURES)

    def grid(s):
        own = F.col("ranges")[s["feature"]]
        low, high = (c.cast("double") for c in ex.curve_range(s["value"], own["low"], own["high"], own["top"]))
        return F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: low + k * (high - low) / 10)

    which = F.transform("shown", lambda s: F.array_position(F.array(*[F.lit(c) for c in FEATURES]), s["feature"]).cast("int") - 1)
    wide = shown.withColumn("which", which).withColumn("grid", F.transform("shown", grid))
    wide = wide.withColumn("tested", model.what_if(F.col("which"), F.col("grid")))
    entries = F.zip_with(F.arrays_zip("shown", "grid"), "tested", lambda e, p: F.struct(e["shown"]["feature"].alias("feature"), F.arrays_zip(e["grid"].alias("value"), p.alias("prediction")).alias("points")))
    each = ex.exploded(wide.select(KEY, entries.alias("entries")), "entries", "e", "place")
    points = ex.exploded(each.select(KEY, "e.feature", "e.points"), "points", "p", "point")
    return points.select(KEY, "feature", "point", rounded(F.col("p.value")).alias("value"), rounded(F.col("p.prediction")).alias("prediction"))


@query("contributions_boosted")
def contributions_boosted(spark, sf_dir) -> DataFrame:
    """The booster's prediction against the segment's mean, shared out by the importances of
    the segment's own trees."""
    rows, _ = boosted_explained(spark, sf_dir)
    models = rows.groupBy("segment").agg(F.first("importances").alias("importances"), F.first("means").alias("means"), F.first("mean_y").alias("mean_y"))
    shares = settle(ex.contribution_shares(ex.ranked_features(models, "segment", FEATURES, 10)).select("segment", "shares"), "boosted-shares")
    gap = F.col("prediction") - F.col("mean_y")
    wide = rows.join(shares, "segment").select(KEY, "mean_y", gap.alias("gap"), "shares")
    each = ex.exploded(wide, "shares", "s")
    return each.select(
        KEY, F.col("s.feature").alias("feature"), (F.col("at") + 1).cast("long").alias("place"),
        rounded(F.col("gap") * F.col("s.share")).alias("contribution"), rounded(F.col("mean_y") + F.col("gap") * F.col("s.running")).alias("running_total"),
    )


def saved_unified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Raw test claims, and where the unified model of the training claims is saved."""
    raw = written_claims(spark, sf_dir).withColumn("split", holdout(F.col(KEY)))
    path = shared_path(spark, "unified")
    UnifiedSegmentedModel().fit(raw.where("split = 'train'")).save(path)
    return finite_target(raw.where("split = 'test'"), TARGET).drop("split"), path


@query("explain_records_unified")
def explain_records_unified(spark, sf_dir) -> DataFrame:
    """What the loaded unified model predicts, the record's segment, and what the segment's
    own booster says."""
    test, path = saved_unified(spark, sf_dir)
    scored = FittedSegmentedModel.load(spark, path).transform(test)
    return scored.select(KEY, sg.shown(F.col("segment")).alias("segment"), rounded(F.col("prediction")).alias("prediction"), rounded(F.col("segment_prediction")).alias("segment_prediction"))


@query("ensemble_weights_unified")
def ensemble_weights_unified(spark, sf_dir) -> DataFrame:
    """Coefficients of the unified model's stack by base model, largest first."""
    _, path = saved_unified(spark, sf_dir)
    return FittedSegmentedModel.load(spark, path).weights()


@query("score_stream_unified")
def score_stream_unified(spark, sf_dir) -> DataFrame:
    """The loaded unified model applied to claim files as they arrive."""
    test, path = saved_unified(spark, sf_dir)
    source, sink = shared_path(spark, "unified-in"), shared_path(spark, "unified-out")
    test.hint("rebalance", KEY).write.parquet(source)
    model = FittedSegmentedModel.load(spark, path)

    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).select(KEY, sg.shown(F.col("segment")).alias("segment"), rounded(F.col("prediction")).alias("prediction"))

    score_stream(spark, source, test.schema, score, sink, shared_path(spark, "unified-state"), files_per_batch=2).awaitTermination()
    return spark.read.parquet(sink)
