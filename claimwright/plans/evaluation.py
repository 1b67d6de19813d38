"""Evaluation tables. Each starts from row-level predictions and aggregates on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimwright.functions.numbers import rounded
from claimwright.operators import metrics as me
from claimwright.operators import segments as sg
from claimwright.operators.linear import fit_linear
from claimwright.plans.base import CRITERIA, base, hierarchy
from claimwright.plans.linear_models import shown_metrics
from claimwright.plans.registry import query
from claimwright.plans.sql import metrics, on_segments
from claimwright.session import settle

MODELS = ["global_mean", "global_ols", "segment_mean", "segment_ols"]

_SCORED = """mdl AS (SELECT segment, avg(y) AS sm, regr_slope(y, total_damages) AS s1,
  regr_intercept(y, total_damages) AS s0 FROM seg WHERE split = 'train' GROUP BY 1),
glb AS (SELECT avg(y) AS gm, regr_slope(y, total_damages) AS g1, regr_intercept(y, total_damages) AS g0
  FROM seg WHERE split = 'train'),
wide AS (SELECT segment, y, gm AS global_mean, g0 + g1 * total_damages AS global_ols, sm AS segment_mean,
  s0 + s1 * total_damages AS segment_ols FROM seg JOIN mdl USING (segment), glb WHERE split = 'test'),
scored AS (""" + " UNION ALL ".join(
    f"SELECT segment, y, '{m}' AS model, {m} AS prediction FROM wide" for m in MODELS
) + "), " + f"mt AS (SELECT model, {metrics()} FROM scored GROUP BY 1)," + """
mx AS (SELECT model, avg((y-prediction)*(y-prediction)) AS mse, sqrt(avg((y-prediction)*(y-prediction))) AS rmse,
  avg(abs(y-prediction)) AS mae, 1 - sum((y-prediction)*(y-prediction)) / (var_pop(y) * count(*)) AS r2 FROM scored GROUP BY 1)"""


def scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Long test predictions ``(segment, model, y, prediction)`` of four models, and the
    whole size of every segment."""
    frame = base(spark, sf_dir, *CRITERIA, "total_damages")
    dictionary = hierarchy(frame)
    rows = settle(
        dictionary.split(frame).select("segment", "split", "y", "total_damages"), "scored-rows"
    )
    train, wide = rows.where("split = 'train'"), rows.where("split = 'test'")
    for name, keys in (("global", []), ("segment", ["segment"])):
        wide = fit_linear(train, [], "y", keys).predict(wide, f"{name}_mean")
        wide = fit_linear(train, ["total_damages"], "y", keys).predict(wide, f"{name}_ols")
    long = wide.select("segment", "y", *MODELS).unpivot(
        ["segment", "y"], MODELS, "model", "prediction"
    )
    return long, dictionary.sizes().withColumnRenamed("n", "n_total")


def model_metrics(spark, sf_dir) -> DataFrame:
    long, _ = scored(spark, sf_dir)
    return me.regression_metrics(long, ["model"])


@query("regression_metrics", on_segments("SELECT * FROM mt", _SCORED))
def regression_metrics(spark, sf_dir) -> DataFrame:
    return shown_metrics(model_metrics(spark, sf_dir), "model")


@query(
    "segment_metrics",
    on_segments(
        f"SELECT segment, {metrics()} FROM scored WHERE model = 'segment_mean' GROUP BY segment", _SCORED
    ),
)
def segment_metrics(spark, sf_dir) -> DataFrame:
    """Test metrics of the segment-mean model per segment, best first."""
    long, _ = scored(spark, sf_dir)
    per = me.regression_metrics(long.where("model = 'segment_mean'"), ["segment"])
    ordered = per.withColumn("segment", sg.shown(F.col("segment"))).orderBy(
        F.col("r2").desc_nulls_last(), "segment"
    )
    return shown_metrics(ordered, "segment")


@query(
    "weighted_metrics",
    on_segments(
        """SELECT model, round(sum(rmse * n_total) / sum(n_total), 4) AS rmse, round(sum(mae * n_total) / sum(n_total), 4) AS mae,
        round(sum(r2 * n_total) / sum(n_total), 6) + 0.0 AS r2, CAST(sum(n_total) AS BIGINT) AS n_total FROM (
        SELECT model, segment, sqrt(avg((y-prediction)*(y-prediction))) AS rmse, avg(abs(y-prediction)) AS mae,
          1 - sum((y-prediction)*(y-prediction)) / (var_pop(y) * count(*)) AS r2 FROM scored GROUP BY 1, 2)
        JOIN (SELECT segment, count(*) AS n_total FROM seg GROUP BY 1) USING (segment) GROUP BY model""",
        _SCORED,
    ),
)
def weighted_metrics(spark, sf_dir) -> DataFrame:
    long, sizes = scored(spark, sf_dir)
    per = me.regression_metrics(long, ["model", "segment"]).join(sizes, "segment")
    return me.weighted_metrics(per, "n_total", ["model"]).select(
        "model",
        rounded(F.col("rmse")).alias("rmse"),
        rounded(F.col("mae")).alias("mae"),
        rounded(F.col("r2"), 6).alias("r2"),
        "n_total",
    )


_GAIN = """(m.r2 - b.r2) / b.r2 * 100 AS g, (b.rmse - m.rmse) / b.rmse * 100 AS h
  FROM mx m, mx b WHERE b.model = 'global_ols'"""


@query(
    "improvement_pct",
    on_segments(
        f"SELECT model, round(g, 4) + 0.0 AS r2_gain_pct, round(h, 4) + 0.0 AS rmse_gain_pct FROM (SELECT m.model, {_GAIN})",
        _SCORED,
    ),
)
def improvement_pct(spark, sf_dir) -> DataFrame:
    gains = me.against_baseline(model_metrics(spark, sf_dir), "global_ols")
    return gains.select(
        "model",
        rounded(F.col("r2_gain_pct")).alias("r2_gain_pct"),
        rounded(F.col("rmse_gain_pct")).alias("rmse_gain_pct"),
    )


@query(
    "leaderboard",
    on_segments(
        "SELECT *, rank() OVER (ORDER BY r2 DESC) AS place FROM mt",
        _SCORED,
    ),
)
def leaderboard(spark, sf_dir) -> DataFrame:
    """Models by R²; the window runs over one row per model."""
    table = shown_metrics(model_metrics(spark, sf_dir), "model")
    place = F.rank().over(W.orderBy(F.col("r2").desc_nulls_last())).cast("long")
    return table.withColumn("place", place).orderBy("place", "model")


@query(
    "best_model",
    on_segments("SELECT max_by(model, r2) AS model, round(max(r2), 6) AS r2 FROM mx", _SCORED),
)
def best_model(spark, sf_dir) -> DataFrame:
    return model_metrics(spark, sf_dir).agg(
        F.max_by("model", "r2").alias("model"), rounded(F.max("r2"), 6).alias("r2")
    )


@query(
    "comparison_pivot",
    on_segments(
        "SELECT metric, "
        + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN v END), 4) + 0.0 AS {m}" for m in MODELS)
        + """ FROM (SELECT model, unnest(['rmse', 'mae', 'r2']) AS metric, unnest([rmse, mae, r2]) AS v FROM mx) GROUP BY metric""",
        _SCORED,
    ),
)
def comparison_pivot(spark, sf_dir) -> DataFrame:
    wide = me.comparison_pivot(model_metrics(spark, sf_dir), MODELS, ["rmse", "mae", "r2"])
    return wide.select("metric", *[rounded(F.col(m)).alias(m) for m in MODELS])


@query(
    "recommendation_tier",
    on_segments(
        f"""SELECT model, CASE WHEN g > 5 THEN 'substantial' WHEN g > 2 THEN 'moderate' ELSE 'minimal' END AS tier
        FROM (SELECT m.model, {_GAIN})""",
        _SCORED,
    ),
)
def recommendation_tier(spark, sf_dir) -> DataFrame:
    gains = me.against_baseline(model_metrics(spark, sf_dir), "global_ols")
    return gains.select("model", me.recommendation_tier(F.col("r2_gain_pct")).alias("tier"))
