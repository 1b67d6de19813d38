"""Linear models, ensembles over them and meta-features: all with an SQL twin."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.numbers import rounded
from claimwright.operators import ensembles as en
from claimwright.operators import models as mo
from claimwright.operators import segments as sg
from claimwright.operators.linear import ALL_FOLDS, fit_linear
from claimwright.operators.metrics import METRICS, metric_columns, regression_metrics
from claimwright.plans.base import CRITERIA, base, hierarchy, segmented
from claimwright.plans.registry import query
from claimwright.plans.sql import metrics, on_base, on_segments
from claimwright.session import settle
from claimwright.sources.claims import KEY

TWO = ["total_special", "total_general"]


def shown_metrics(df: DataFrame, *first: str) -> DataFrame:
    """Metric columns rounded as the SQL twins round them."""
    return df.select(
        *first,
        "n",
        *[rounded(F.col(m), 6 if m == "r2" else 4).alias(m) for m in METRICS],
    )


def two_feature_sql(l1: str, l2: str) -> str:
    """Penalised least squares on both totals, in closed form (both slopes are positive)."""
    return on_base(
        f"""SELECT round(b0, 4) AS intercept, round(b1, 6) AS slope_special, round(b2, 6) AS slope_general,
        {metrics('y', '(b0 + b1 * total_special + b2 * total_general)')}
        FROM base, sol WHERE split = 'test' GROUP BY b0, b1, b2""",
        """mo AS (SELECT count(*) AS n, avg(total_special) AS a1, avg(total_general) AS a2, avg(y) AS ay,
          var_pop(total_special) AS v1, var_pop(total_general) AS v2, covar_pop(total_special, total_general) AS v12,
          covar_pop(total_special, y) AS c1, covar_pop(total_general, y) AS c2 FROM base WHERE split = 'train')""",
        f"""pen AS (SELECT *, v1 + ({l2}) AS w1, v2 + ({l2}) AS w2, c1 - ({l1}) AS d1, c2 - ({l1}) AS d2 FROM mo),
        slo AS (SELECT *, (d1 * w2 - d2 * v12) / (w1 * w2 - v12 * v12) AS b1,
          (d2 * w1 - d1 * v12) / (w1 * w2 - v12 * v12) AS b2 FROM pen),
        sol AS (SELECT *, ay - b1 * a1 - b2 * a2 AS b0 FROM slo)""",
    )


def _linear_query(spark, sf_dir, estimator) -> DataFrame:
    frame = settle(base(spark, sf_dir, *TWO).select("y", "split", *TWO), "linear-frame")
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    n, deviation = mo.target_deviation(train, "y")
    model = mo.fit_on(train, TWO, estimator(n, deviation))
    fitted = model.stages[-1]
    result = regression_metrics(model.transform(test))
    return shown_metrics(
        result.withColumns(
            {
                "intercept": F.round(F.lit(fitted.intercept), 4),
                "slope_special": F.round(F.lit(float(fitted.coefficients[0])), 6),
                "slope_general": F.round(F.lit(float(fitted.coefficients[1])), 6),
            }
        ),
        "intercept",
        "slope_special",
        "slope_general",
    )


@query("linear_regression", two_feature_sql("0", "0"))
def linear_regression(spark, sf_dir) -> DataFrame:
    return _linear_query(spark, sf_dir, lambda n, s: LinearRegression(labelCol="y", solver="normal"))


@query("ridge", two_feature_sql("0", "1000.0 / n"))
def ridge(spark, sf_dir) -> DataFrame:
    return _linear_query(spark, sf_dir, lambda n, s: mo.ridge(1000.0, n, s))


@query("lasso", two_feature_sql("1.0", "0"))
def lasso(spark, sf_dir) -> DataFrame:
    return _linear_query(spark, sf_dir, lambda n, s: mo.elastic_net(1.0, 1.0, s))


@query("elastic_net", two_feature_sql("0.01 * 0.5", "0.01 * 0.5"))
def elastic_net(spark, sf_dir) -> DataFrame:
    return _linear_query(spark, sf_dir, lambda n, s: mo.elastic_net(0.01, 0.5, s))


@query("sgd_linear", two_feature_sql("0.01 * 0.5", "0.01 * 0.5"))
def sgd_linear(spark, sf_dir) -> DataFrame:
    """The objective of the stochastic-gradient model, minimised by quasi-Newton steps on
    distributed gradients. pyspark.ml scales by the sample deviation with this solver."""

    return _linear_query(spark, sf_dir, lambda n, s: mo.elastic_net(0.01, 0.5, s, rows=n, solver="l-bfgs"))


# --- models per segment -------------------------------------------------------------

_TRAINED = """mdl AS (SELECT segment, avg(y) AS mean_y, regr_slope(y, total_damages) AS b1,
  regr_intercept(y, total_damages) AS b0, count(*) AS n_train FROM seg WHERE split = 'train' GROUP BY 1),
all_mdl AS (SELECT avg(y) AS g_mean, regr_slope(y, total_damages) AS g1, regr_intercept(y, total_damages) AS g0
  FROM seg WHERE split = 'train')"""


@query(
    "per_segment_models",
    on_segments(
        f"""SELECT segment, n_total, round(b0, 4) AS intercept, round(b1, 6) AS slope, round(mean_y, 4) AS mean_y,
        {metrics('y', '(b0 + b1 * total_damages)')} FROM seg JOIN mdl USING (segment) JOIN (SELECT segment, count(*) AS n_total
        FROM seg GROUP BY 1) USING (segment) WHERE split = 'test' GROUP BY segment, n_total, b0, b1, mean_y""",
        _TRAINED,
    ),
)
def per_segment_models(spark, sf_dir) -> DataFrame:
    """Least squares and mean of every segment in one aggregation, whatever their number."""
    frame = base(spark, sf_dir, *CRITERIA, "total_damages")
    dictionary = hierarchy(frame)
    rows = settle(
        dictionary.split(frame).select("segment", "split", "y", "total_damages"), "segment-rows"
    )
    models = fit_linear(rows.where("split = 'train'"), ["total_damages"], "y", ["segment"])
    scored = models.predict(rows.where("split = 'test'"), "prediction")
    fitted = models.table.where(F.col("fold") == ALL_FOLDS).select(
        "segment",
        F.round("intercept", 4).alias("intercept"),
        F.round(F.col("slopes")[0], 6).alias("slope"),
        F.round("mean_y", 4).alias("mean_y"),
    )
    sizes = dictionary.sizes().withColumnRenamed("n", "n_total")
    result = (
        shown_metrics(regression_metrics(scored, ["segment"]), "segment")
        .join(fitted, "segment")
        .join(sizes, "segment")
    )
    return result.withColumn("segment", sg.shown(F.col("segment")))


@query(
    "baseline_model",
    on_segments(
        f"""SELECT round(g0, 4) AS intercept, round(g1, 6) AS slope, {metrics('y', '(g0 + g1 * total_damages)')}
        FROM seg, all_mdl WHERE split = 'test' GROUP BY g0, g1""",
        _TRAINED,
    ),
)
def baseline_model(spark, sf_dir) -> DataFrame:
    rows = settle(segmented(spark, sf_dir, "total_damages").select("split", "y", "total_damages"), "baseline-rows")
    model = fit_linear(rows.where("split = 'train'"), ["total_damages"], "y")
    fitted = model.only()
    scored = model.predict(rows.where("split = 'test'"), "prediction")
    return shown_metrics(
        regression_metrics(scored).withColumns(
            {
                "intercept": F.round(F.lit(fitted["intercept"]), 4),
                "slope": F.round(F.lit(fitted["slopes"][0]), 6),
            }
        ),
        "intercept",
        "slope",
    )


@query(
    "segment_mean_fallback",
    on_base(
        """SELECT claim_id, round(coalesce(CASE WHEN n_fit >= 100 THEN b0 + b1 * total_damages END, seg_mean, g_mean), 4) AS prediction,
        CASE WHEN n_fit >= 100 THEN 'model' WHEN seg_mean IS NOT NULL THEN 'segment mean' ELSE 'overall mean' END AS source
        FROM base LEFT JOIN m ON s = accident_type, g WHERE split = 'test'""",
        """m AS (SELECT accident_type AS s, count(*) AS n_fit, avg(y) AS seg_mean, regr_slope(y, total_damages) AS b1,
          regr_intercept(y, total_damages) AS b0 FROM base WHERE split = 'train' GROUP BY 1 HAVING count(*) >= 7)""",
        "g AS (SELECT avg(y) AS g_mean FROM base WHERE split = 'train')",
    ),
)
def segment_mean_fallback(spark, sf_dir) -> DataFrame:
    """A fit needs 100 rows, a segment 7; below that the segment's or the overall mean."""
    frame = base(spark, sf_dir, "accident_type", "total_damages")
    train = frame.where("split = 'train'")
    fitted = fit_linear(train, ["total_damages"], "y", ["accident_type"])
    overall = fit_linear(train, [], "y").only()["mean_y"]
    usable = fitted.table.where(F.col("n") >= 7).select(
        "accident_type", "n", "mean_y", "intercept", F.col("slopes")[0].alias("slope")
    )
    scored = frame.where("split = 'test'").join(usable, "accident_type", "left")
    own = F.when(F.col("n") >= 100, F.col("intercept") + F.col("slope") * F.col("total_damages"))
    source = (
        F.when(F.col("n") >= 100, "model")
        .when(F.col("mean_y").isNotNull(), "segment mean")
        .otherwise("overall mean")
    )
    return scored.select(
        KEY,
        rounded(en.with_fallback(own, F.col("mean_y"), overall)).alias("prediction"),
        source.alias("source"),
    )


@query(
    "clip_nonnegative",
    on_base(
        """SELECT claim_id, round(greatest(b0 + b1 * age_damage_ratio, 0), 4) + 0.0 AS prediction,
        b0 + b1 * age_damage_ratio < 0 AS clipped
        FROM b2, (SELECT regr_slope(y, age_damage_ratio) AS b1, regr_intercept(y, age_damage_ratio) AS b0
        FROM b2 WHERE split = 'train')""",
        "b2 AS (SELECT *, driver_age / CASE WHEN total_special = 0 THEN 1 ELSE total_special END AS age_damage_ratio FROM base)",
    ),
)
def clip_nonnegative(spark, sf_dir) -> DataFrame:
    """A steeply falling model, which is negative for large ratios."""
    frame = base(spark, sf_dir, "age_damage_ratio")
    model = fit_linear(frame.where("split = 'train'"), ["age_damage_ratio"], "y")
    scored = model.predict(frame, "raw")
    return scored.select(
        KEY,
        rounded(en.clip_nonnegative(F.col("raw"))).alias("prediction"),
        (F.col("raw") < 0).alias("clipped"),
    )


# --- ensembles ----------------------------------------------------------------------

BASES = {
    "mean": en.LinearBase("mean", keys=["accident_type"]),
    "special": en.LinearBase("special", ["total_special"]),
    "general": en.LinearBase("general", ["total_general"]),
}
PREDICTIONS = [f"pred_{b}" for b in BASES]
BASE_COLUMNS = ["accident_type", *TWO]


def _predictions_sql(train: str) -> str:
    return f"""bm AS (SELECT accident_type AS s, avg(y) AS pm FROM base WHERE {train} GROUP BY 1),
    bg AS (SELECT regr_slope(y, total_special) AS s1, regr_intercept(y, total_special) AS s0,
      regr_slope(y, total_general) AS g1, regr_intercept(y, total_general) AS g0 FROM base WHERE {train}),
    pr AS (SELECT base.*, coalesce(pm, 0) AS pred_mean, s0 + s1 * total_special AS pred_special,
      g0 + g1 * total_general AS pred_general FROM base LEFT JOIN bm ON s = accident_type, bg)"""


def predictions(frame: DataFrame, train: str) -> DataFrame:
    """The fixed prediction table: three base learners fitted on the rows of ``train``."""
    rows = frame.where(train)
    models = {n: fit_linear(rows, b.features, "y", b.keys) for n, b in BASES.items()}
    return en.base_predictions(frame, models, False)


@query(
    "voting_weighted",
    on_base(
        """SELECT claim_id, round((w1 * pred_mean + w2 * pred_special + w3 * pred_general) / (w1 + w2 + w3), 4) AS prediction
        FROM pr, w WHERE fold = 0""",
        _predictions_sql("fold > 1"),
        "w AS (SELECT "
        + ", ".join(
            f"greatest(1 - sum((y-{p})*(y-{p})) / (var_pop(y) * count(*)), 0) AS w{i}"
            for i, p in enumerate(PREDICTIONS, 1)
        )
        + " FROM pr WHERE fold = 1)",
    ),
)
def voting_weighted(spark, sf_dir) -> DataFrame:
    """Weights from a validation fold that neither fits the models nor is scored."""
    scored = settle(
        predictions(base(spark, sf_dir, *BASE_COLUMNS), "fold > 1").select(KEY, "y", "fold", *PREDICTIONS),
        "votes",
    )
    weights = en.vote_weights(scored.where("fold = 1"), PREDICTIONS)
    return scored.where("fold = 0").select(
        KEY, rounded(en.weighted_vote(weights)).alias("prediction")
    )


@query(
    "voting_uniform",
    on_base(
        "SELECT claim_id, round((pred_mean + pred_special + pred_general) / 3, 4) AS prediction FROM pr WHERE split = 'test'",
        _predictions_sql("split = 'train'"),
    ),
)
def voting_uniform(spark, sf_dir) -> DataFrame:
    scored = predictions(base(spark, sf_dir, *BASE_COLUMNS), "split = 'train'").where("split = 'test'")
    return scored.select(KEY, rounded(en.mean_vote(PREDICTIONS)).alias("prediction"))


@query(
    "mean_ensemble",
    on_base(
        f"SELECT {metrics('y', '((pred_special + pred_general) / 2)')} FROM pr WHERE split = 'test'",
        _predictions_sql("split = 'train'"),
    ),
)
def mean_ensemble(spark, sf_dir) -> DataFrame:
    """The mean of a named subset of the base learners, and its metrics."""
    scored = predictions(base(spark, sf_dir, *BASE_COLUMNS), "split = 'train'").where("split = 'test'")
    vote = en.mean_vote(["pred_special", "pred_general"])
    return shown_metrics(regression_metrics(scored.select("y", vote.alias("prediction"))))


STACK = [
    en.LinearBase("mean", keys=["accident_type"]),
    en.LinearBase("damages", ["total_damages"], ["exceptional_circumstances"]),
]

STACK_SQL = """k5 AS (SELECT unnest(range(5)) AS f),
  tr AS (SELECT * FROM base WHERE split = 'train'),
  am AS (SELECT f, accident_type AS s, avg(y) AS pm FROM tr, k5 WHERE inner_fold <> f GROUP BY 1, 2
    UNION ALL SELECT -1, accident_type, avg(y) FROM tr GROUP BY 2),
  ad AS (SELECT f, exceptional_circumstances AS p, regr_slope(y, total_damages) AS d1, regr_intercept(y, total_damages) AS d0
    FROM tr, k5 WHERE inner_fold <> f GROUP BY 1, 2
    UNION ALL SELECT -1, exceptional_circumstances, regr_slope(y, total_damages), regr_intercept(y, total_damages) FROM tr GROUP BY 2),
  st AS (SELECT b.*, coalesce(pm, 0) AS pred_mean, coalesce(d0 + d1 * total_damages, 0) AS pred_damages
    FROM (SELECT *, CASE WHEN split = 'train' THEN inner_fold ELSE -1 END AS mf FROM base) b
    LEFT JOIN am ON am.f = mf AND am.s = accident_type
    LEFT JOIN ad ON ad.f = mf AND ad.p = exceptional_circumstances),
  sm AS (SELECT count(*) AS n, avg(pred_mean) AS a1, avg(pred_damages) AS a2, avg(y) AS ay,
    var_pop(pred_mean) + 0.1 / count(*) AS w1, var_pop(pred_damages) + 0.1 / count(*) AS w2,
    covar_pop(pred_mean, pred_damages) AS v12, covar_pop(pred_mean, y) AS c1, covar_pop(pred_damages, y) AS c2
    FROM st WHERE split = 'train'),
  sw AS (SELECT *, (c1 * w2 - c2 * v12) / (w1 * w2 - v12 * v12) AS b1, (c2 * w1 - c1 * v12) / (w1 * w2 - v12 * v12) AS b2 FROM sm),
  ss AS (SELECT *, ay - b1 * a1 - b2 * a2 AS b0 FROM sw)"""


@query(
    "stacking",
    on_base(
        """SELECT claim_id, round(pred_mean, 4) AS pred_mean, round(pred_damages, 4) AS pred_damages,
        round(b0 + b1 * pred_mean + b2 * pred_damages, 4) AS prediction FROM st, ss WHERE split = 'test'""",
        STACK_SQL,
    ),
)
def stacking(spark, sf_dir) -> DataFrame:
    """Ridge (0.1) over out-of-fold predictions of group means and group least squares."""
    frame = settle(
        base(spark, sf_dir, *CRITERIA, "total_damages").select(
            KEY, "y", "split", "inner_fold", "accident_type", "exceptional_circumstances", "total_damages"
        ),
        "stack-frame",
    )
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    scored, _ = en.linear_stack(train, test, STACK, "inner_fold", l2=0.1)
    return scored.select(
        KEY, *[rounded(F.col(c)).alias(c) for c in ("pred_mean", "pred_damages", "prediction")]
    )


@query(
    "ensemble_weights",
    on_base(
        """SELECT input, round(weight, 6) AS weight, CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS sign,
        row_number() OVER (ORDER BY abs(weight) DESC) AS weight_rank, n_rows FROM (
        SELECT 'mean' AS input, b1 AS weight, n AS n_rows FROM ss UNION ALL SELECT 'damages', b2, n FROM ss)""",
        STACK_SQL,
    ),
)
def ensemble_weights(spark, sf_dir) -> DataFrame:
    """Meta-model coefficients, labelled by base model, by absolute size."""
    frame = base(spark, sf_dir, *CRITERIA, "total_damages")
    _, meta = en.linear_stack(
        frame.where("split = 'train'"), frame.where("split = 'test'"), STACK, "inner_fold", l2=0.1
    )
    names = F.array(*[F.lit(b.name) for b in STACK])
    weights = meta.table.where(F.col("fold") == ALL_FOLDS).select(
        F.col("n").cast("long").alias("n_rows"),
        F.explode(F.arrays_zip(names.alias("input"), F.col("slopes").alias("weight"))).alias("w"),
    ).select("w.input", "w.weight", "n_rows")
    from pyspark.sql import Window as W

    order = W.orderBy(F.abs("weight").desc(), "input")  # one row per base model
    return (
        weights.withColumn("weight_rank", F.row_number().over(order).cast("long"))
        .where("weight_rank <= 10")
        .select(
            "input",
            F.round("weight", 6).alias("weight"),
            F.when(F.col("weight") > 0, "positive").otherwise("negative").alias("sign"),
            "weight_rank",
            "n_rows",
        )
    )


SEGMENTS = ["No", "Unknown", "Yes"]  # the values in the tables, for the SQL twins only

_META_SQL = """k5 AS (SELECT unnest(range(5)) AS f),
  tr AS (SELECT * FROM base WHERE split = 'train'),
  co AS (SELECT f, exceptional_circumstances AS p, regr_slope(y, total_damages) AS d1, regr_intercept(y, total_damages) AS d0
    FROM tr, k5 WHERE inner_fold <> f GROUP BY 1, 2
    UNION ALL SELECT -1, exceptional_circumstances, regr_slope(y, total_damages), regr_intercept(y, total_damages) FROM tr GROUP BY 2),
  ap AS (SELECT claim_id, exceptional_circumstances AS own, total_damages, total_special, total_general, y, split, """ + ", ".join(
    f"max(CASE WHEN p = '{s}' THEN d0 + d1 * total_damages END) AS all_{s}" for s in SEGMENTS
) + """ FROM base JOIN co ON f = CASE WHEN split = 'train' THEN inner_fold ELSE -1 END GROUP BY ALL)"""


def _meta_frame(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Own and all segment predictions, and the segments' names as fitted; training rows get
    the predictions of their left-out fold."""
    frame = base(spark, sf_dir, "exceptional_circumstances", "total_damages")
    train = frame.where("split = 'train'").withColumn("fold", F.col("inner_fold"))
    models = fit_linear(train, ["total_damages"], "y", ["exceptional_circumstances"], "fold")
    outside = F.when(F.col("split") == "train", F.col("inner_fold"))
    names = en.fitted_groups(models, "exceptional_circumstances")
    return en.meta_features_wide(
        frame.withColumn("left_out", outside), models, "exceptional_circumstances", names, "left_out"
    ), names


@query(
    "meta_features_wide",
    on_base(
        "SELECT claim_id, "
        + ", ".join(f"round(CASE WHEN own = '{s}' THEN all_{s} END, 4) AS pred_{s}" for s in SEGMENTS)
        + ", "
        + ", ".join(f"round(all_{s}, 4) AS all_pred_{s}" for s in SEGMENTS)
        + """, round(CASE own WHEN 'No' THEN all_No WHEN 'Yes' THEN all_Yes ELSE all_Unknown END, 4) AS pred_mean,
        round((all_No + all_Unknown + all_Yes) / 3, 4) AS all_pred_mean,
        round(CASE own WHEN 'No' THEN all_No WHEN 'Yes' THEN all_Yes ELSE all_Unknown END, 4) AS segment_prediction
        FROM ap""",
        _META_SQL,
    ),
)
def meta_features_wide(spark, sf_dir) -> DataFrame:
    frame, segments = _meta_frame(spark, sf_dir)
    names = [f"pred_{s}" for s in segments] + [f"all_pred_{s}" for s in segments]
    names += ["pred_mean", "all_pred_mean", "segment_prediction"]
    return frame.select(KEY, *[rounded(F.col(c)).alias(c) for c in names])


@query(
    "meta_features_unified",
    on_base(
        "SELECT claim_id, "
        + ", ".join(f"round(CASE WHEN own = '{s}' THEN all_{s} ELSE 0 END, 4) AS pred_{s}" for s in SEGMENTS)
        + ", total_special, total_general, total_damages AS total_damages_meta FROM ap",
        _META_SQL,
    ),
)
def meta_features_unified(spark, sf_dir) -> DataFrame:
    frame, segments = _meta_frame(spark, sf_dir)
    names = [f"pred_{s}" for s in segments]
    frame = frame.na.fill(0.0, names)
    return frame.select(
        KEY,
        *[rounded(F.col(c)).alias(c) for c in names],
        "total_special",
        "total_general",
        F.col("total_damages").alias("total_damages_meta"),
    )


@query(
    "segment_prediction_feature",
    on_base(
        f"""SELECT round(b0, 4) AS intercept, round(b1, 6) AS slope_segment, round(b2, 6) AS slope_general,
        {metrics('y', '(b0 + b1 * sp + b2 * total_general)')} FROM mf, so WHERE split = 'test' GROUP BY b0, b1, b2""",
        _META_SQL,
        """mf AS (SELECT *, CASE own WHEN 'No' THEN all_No WHEN 'Yes' THEN all_Yes ELSE all_Unknown END AS sp FROM ap)""",
        """mm AS (SELECT avg(sp) AS a1, avg(total_general) AS a2, avg(y) AS ay, var_pop(sp) AS w1, var_pop(total_general) AS w2,
          covar_pop(sp, total_general) AS v12, covar_pop(sp, y) AS c1, covar_pop(total_general, y) AS c2 FROM mf WHERE split = 'train')""",
        """sl AS (SELECT *, (c1 * w2 - c2 * v12) / (w1 * w2 - v12 * v12) AS b1, (c2 * w1 - c1 * v12) / (w1 * w2 - v12 * v12) AS b2 FROM mm)""",
        "so AS (SELECT *, ay - b1 * a1 - b2 * a2 AS b0 FROM sl)",
    ),
)
def segment_prediction_feature(spark, sf_dir) -> DataFrame:
    """A row's own-segment prediction (0 if it has none) as a feature of a global model."""
    frame = settle(
        _meta_frame(spark, sf_dir)[0]
        .na.fill(0.0, ["segment_prediction"])
        .select("y", "split", "segment_prediction", "total_general"),
        "segment-feature",
    )
    features = ["segment_prediction", "total_general"]
    model = fit_linear(frame.where("split = 'train'"), features, "y")
    fitted = model.only()
    scored = model.predict(frame.where("split = 'test'"), "prediction")
    return shown_metrics(
        regression_metrics(scored).withColumns(
            {
                "intercept": F.round(F.lit(fitted["intercept"]), 4),
                "slope_segment": F.round(F.lit(fitted["slopes"][0]), 6),
                "slope_general": F.round(F.lit(fitted["slopes"][1]), 6),
            }
        ),
        "intercept",
        "slope_segment",
        "slope_general",
    )
