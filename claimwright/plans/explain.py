"""Explanation tables over all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.numbers import rounded
from claimwright.functions.quantiles import exact_quantiles
from claimwright.operators import ensembles as en
from claimwright.operators import explain as ex
from claimwright.operators import segments as sg
from claimwright.operators.features import row_total
from claimwright.operators.linear import fit_linear
from claimwright.operators.metrics import regression_metrics
from claimwright.operators.neighbours import distance_weighted, nearest
from claimwright.plans.base import CRITERIA, base, hierarchy, segmented
from claimwright.plans.linear_models import BASE_COLUMNS, PREDICTIONS, STACK, STACK_SQL, _predictions_sql, predictions
from claimwright.plans.registry import query
from claimwright.plans.sql import on_base, on_claims, on_segments
from claimwright.session import settle
from claimwright.sources.claims import GENERAL, KEY, SPECIAL, claims

FEATURES = [
    "special_care", "special_earnings", "special_medical", "general_rest", "general_pain",
    "total_special", "total_general", "driver_age", "vehicle_age",
    "severe_injury", "whiplash_flag", "psych_flag",
]


def _show(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", sg.shown(F.col("segment")))


def explained(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segmented records and their segments' fitted models (training rows only)."""
    frame = base(spark, sf_dir, *CRITERIA, *FEATURES)
    rows = settle(
        hierarchy(frame).split(frame).select(KEY, "segment", "split", "y", *CRITERIA, *FEATURES),
        "explained-rows",
    )
    models = ex.fit_segment_models(rows.where("split = 'train'"), "segment", FEATURES, "y")
    return rows, models


def _n(values: list[str]) -> str:
    return ", ".join(values)


# fit(segment, feature, imp, a, b, mean_x), one row per segment and feature
_LONG = " UNION ALL ".join(
    f"SELECT claim_id, segment, split, y, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM seg" for f in FEATURES
)
_FIT = f"""long AS ({_LONG}),
fit0 AS (SELECT segment, feature, avg(x) AS mean_x, avg(y) AS mean_y, count(*) AS n,
  CASE WHEN var_pop(x) > 0 THEN abs(corr(x, y)) ELSE 0 END AS strength,
  CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) ELSE 0 END / {len(FEATURES)}.0 AS b,
  CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) ELSE avg(y) END / {len(FEATURES)}.0 AS a
  FROM long WHERE split = 'train' GROUP BY 1, 2),
tot AS (SELECT segment, sum(strength) AS total FROM fit0 GROUP BY 1),
fit AS (SELECT fit0.*, strength / total AS imp,
  row_number() OVER (PARTITION BY segment ORDER BY round(strength / total, 9) DESC, feature) AS rk
  FROM fit0 JOIN tot USING (segment)),
prd AS (SELECT claim_id, any_value(y) AS y, sum(a + b * x) AS prediction FROM long JOIN fit USING (segment, feature) GROUP BY 1)"""


@query(
    "explain_records",
    on_segments(
        """SELECT claim_id, segment, round(b0 + b1 * pred_mean + b2 * pred_damages, 4) AS prediction,
        round(s0 + s1 * seg.total_damages, 4) AS segment_prediction
        FROM seg JOIN (SELECT claim_id, pred_mean, pred_damages FROM st) USING (claim_id)
        JOIN (SELECT segment, regr_slope(y, total_damages) AS s1, regr_intercept(y, total_damages) AS s0 FROM seg
          WHERE split = 'train' GROUP BY 1) USING (segment), ss WHERE split = 'test'""",
        STACK_SQL,
    ),
)
def explain_records(spark, sf_dir) -> DataFrame:
    """Prediction of the whole stack, the record's segment, and what that segment's model
    alone says."""
    frame = base(spark, sf_dir, *CRITERIA, "total_damages")
    rows = settle(
        hierarchy(frame).assign(frame).select(
            KEY, "segment", "y", "split", "inner_fold", *CRITERIA, "total_damages"
        ),
        "explain-frame",
    )
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    scored, _ = en.linear_stack(train, test, STACK, "inner_fold", l2=0.1)
    own = fit_linear(train.where("segment IS NOT NULL"), ["total_damages"], "y", ["segment"])
    result = own.predict(scored.where("segment IS NOT NULL"), "segment_prediction")
    return _show(result).select(
        KEY,
        "segment",
        rounded(F.col("prediction")).alias("prediction"),
        rounded(F.col("segment_prediction")).alias("segment_prediction"),
    )


@query(
    "segment_profile",
    on_segments(
        """SELECT claim_id, segment, exceptional_circumstances, accident_type, n_total,
        round(r2, 6) + 0.0 AS r2, round(rmse, 4) AS rmse FROM seg JOIN (
          SELECT segment, 1 - sum((y-p)*(y-p)) / nullif(var_pop(y) * count(*), 0) AS r2, sqrt(avg((y-p)*(y-p))) AS rmse
          FROM (SELECT segment, y, prediction AS p FROM prd JOIN (SELECT claim_id, segment, split FROM seg) USING (claim_id) WHERE split = 'test')
          GROUP BY 1) USING (segment)
        JOIN (SELECT segment, count(*) AS n_total FROM seg GROUP BY 1) USING (segment)""",
        _FIT,
    ),
)
def segment_profile(spark, sf_dir) -> DataFrame:
    rows, models = explained(spark, sf_dir)
    scored = rows.where("split = 'test'").join(models, "segment")
    quality = regression_metrics(
        scored.select("segment", "y", ex.predicted(FEATURES).alias("prediction")), ["segment"]
    ).select("segment", "r2", "rmse")
    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_total"))
    profile = settle(quality.join(sizes, "segment"), "segment-profile")
    return _show(rows.join(profile, "segment")).select(
        KEY,
        "segment",
        *CRITERIA,
        "n_total",
        rounded(F.col("r2"), 6).alias("r2"),
        rounded(F.col("rmse")).alias("rmse"),
    )


@query(
    "feature_select_mean",
    on_segments(
        """SELECT segment, feature, round(imp, 6) AS importance FROM (
          SELECT *, count(CASE WHEN high THEN 1 END) OVER (PARTITION BY segment) AS n_high FROM (
            SELECT segment, feature, imp, rk, imp >= avg(imp) OVER (PARTITION BY segment) AS high FROM fit))
        WHERE CASE WHEN n_high >= 3 THEN high ELSE rk <= 3 END""",
        _FIT,
    ),
)
def feature_select_mean(spark, sf_dir) -> DataFrame:
    _, models = explained(spark, sf_dir)
    chosen = ex.selected_features(models, "segment", FEATURES)
    return _show(chosen).withColumn("importance", rounded(F.col("importance"), 6))


@query(
    "record_vs_segment",
    on_segments(
        """SELECT claim_id, segment, feature, rk AS importance_rank, x AS record_value, round(mean_x, 4) AS segment_mean
        FROM long JOIN fit USING (segment, feature) WHERE rk <= 5""",
        _FIT,
    ),
)
def record_vs_segment(spark, sf_dir) -> DataFrame:
    """The segment's five most important features: the record's value and the mean."""
    rows, models = explained(spark, sf_dir)
    ranked = ex.ranked_features(models, "segment", FEATURES, 5).select("segment", "ranked")
    table = F.map_from_arrays(ex.names_of(FEATURES), ex.values_of(FEATURES))
    found = rows.join(settle(ranked, "ranked-features"), "segment").select(
        KEY, "segment", table.alias("values"), F.posexplode("ranked").alias("at", "top")
    )
    return _show(found).select(
        KEY,
        "segment",
        F.col("top.feature").alias("feature"),
        (F.col("at") + 1).cast("long").alias("importance_rank"),
        F.col("values")[F.col("top.feature")].alias("record_value"),
        rounded(F.col("top.mean")).alias("segment_mean"),
    )


@query(
    "contributions",
    on_segments(
        """SELECT claim_id, feature, rk AS place, round((prediction - mean_y) * share, 4) + 0.0 AS contribution,
        round(mean_y + (prediction - mean_y) * running, 4) + 0.0 AS running_total
        FROM prd JOIN (SELECT claim_id, segment FROM seg) USING (claim_id) JOIN (
          SELECT segment, feature, rk, mean_y, imp / sum(imp) OVER (PARTITION BY segment) AS share,
            sum(imp) OVER (PARTITION BY segment ORDER BY rk ROWS UNBOUNDED PRECEDING) / sum(imp) OVER (PARTITION BY segment) AS running
          FROM fit WHERE rk <= 10 AND imp > 0.01) USING (segment)""",
        _FIT,
    ),
)
def contributions(spark, sf_dir) -> DataFrame:
    """How the ten most important features share the gap between prediction and segment
    mean. Shares are the same for all records of a segment, so they are computed there."""
    rows, models = explained(spark, sf_dir)
    shares = ex.contribution_shares(ex.ranked_features(models, "segment", FEATURES, 10))
    shares = settle(shares.select("segment", "mean_y", "intercept", "slopes", "shares"), "shares")
    scored = rows.join(shares, "segment").select(
        KEY,
        "mean_y",
        (ex.predicted(FEATURES) - F.col("mean_y")).alias("gap"),
        F.posexplode("shares").alias("at", "s"),
    )
    return scored.select(
        KEY,
        F.col("s.feature").alias("feature"),
        (F.col("at") + 1).cast("long").alias("place"),
        rounded(F.col("gap") * F.col("s.share")).alias("contribution"),
        rounded(F.col("mean_y") + F.col("gap") * F.col("s.running")).alias("running_total"),
    )


_KIND = (
    "CASE "
    + " ".join(f"WHEN feature = '{f}' THEN '{ex.kind_of(f)}'" for f in FEATURES)
    + " END"
)
_SCREEN = f"""tst AS (SELECT claim_id, feature, x, b, imp, prediction,
    greatest(0.1, CASE WHEN x = 0 THEN 100 ELSE x * 0.5 END) AS lo0, CASE WHEN x = 0 THEN 1000 ELSE x * 1.5 END AS hi0
    FROM long JOIN fit USING (segment, feature) JOIN prd USING (claim_id)
    WHERE feature LIKE 'total_%' OR abs(x) >= 0.1),
  chg AS (SELECT *, abs(b * (CASE WHEN abs(hi0 - lo0) < 1 THEN x + 100 ELSE hi0 END
    - CASE WHEN abs(hi0 - lo0) < 1 THEN greatest(0, x - 100) ELSE lo0 END)) AS change FROM tst),
  shr AS (SELECT *, CASE WHEN prediction > 0 THEN change / prediction ELSE 0 END AS share FROM chg),
  scr AS (SELECT claim_id, feature, {_KIND} AS kind, change, share, share * 0.7 + imp * 0.3 AS score
    FROM shr WHERE change > 1.0 OR share > 0.005)"""


def _with_models(spark, sf_dir) -> DataFrame:
    rows, models = explained(spark, sf_dir)
    return rows.join(models.drop("means"), "segment").withColumn(
        "prediction", ex.predicted(FEATURES)
    )


@query(
    "sensitivity_screen",
    on_segments(
        """SELECT claim_id, feature, kind, round(change, 4) AS change, round(share, 6) AS share, round(score, 6) AS score FROM scr""",
        _FIT,
        _SCREEN,
    ),
)
def sensitivity_screen(spark, sf_dir) -> DataFrame:
    found = ex.screened(_with_models(spark, sf_dir), KEY, FEATURES)
    return found.select(
        KEY,
        "feature",
        "kind",
        rounded(F.col("change")).alias("change"),
        rounded(F.col("share"), 6).alias("share"),
        rounded(F.col("score"), 6).alias("score"),
    )


_SHOWN = """shw AS (SELECT claim_id, feature, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY
    CASE WHEN in_kind <= quota THEN ord ELSE 9 END, overall) AS place FROM (
      SELECT claim_id, feature, kind, CASE kind WHEN 'damage' THEN 2 ELSE 1 END AS quota,
        CASE kind WHEN 'damage' THEN 1 WHEN 'injury' THEN 2 WHEN 'demographic' THEN 3 ELSE 4 END AS ord,
        row_number() OVER (PARTITION BY claim_id, kind ORDER BY round(score, 9) DESC, feature) AS in_kind,
        row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 9) DESC, feature) AS overall FROM scr))
    WHERE place <= 5)"""


@query(
    "diverse_top_features",
    on_segments(
        "SELECT * FROM shw",
        _FIT,
        _SCREEN,
        _SHOWN,
    ),
)
def diverse_top_features(spark, sf_dir) -> DataFrame:
    return ex.diverse(_with_models(spark, sf_dir), KEY, FEATURES)


@query(
    "sensitivity_curve",
    on_segments(
        """SELECT claim_id, feature, CAST(g AS INTEGER) AS point, round(lo + g * (hi - lo) / 10, 4) + 0.0 AS value,
        round(prediction + b * (lo + g * (hi - lo) / 10 - x), 4) + 0.0 AS prediction FROM (
          SELECT claim_id, feature, x, b, prediction,
            CASE WHEN abs(x) >= 0.1 THEN greatest(0, x * 0.2) WHEN p90 - greatest(0, p10) < 1 THEN 0 ELSE greatest(0, p10) END AS lo,
            CASE WHEN abs(x) >= 0.1 THEN x * 2 WHEN p90 - greatest(0, p10) < 1 THEN greatest(1000, mx * 1.2) ELSE p90 END AS hi
          FROM long JOIN fit USING (segment, feature) JOIN prd USING (claim_id) JOIN qs USING (segment, feature)
            JOIN (SELECT claim_id, feature FROM shw) USING (claim_id, feature)),
        (SELECT unnest(range(11)) AS g)""",
        _FIT,
        _SCREEN,
        _SHOWN,
        """qs AS (SELECT segment, feature, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90, max(x) AS mx
          FROM long GROUP BY 1, 2)""",
    ),
)
def sensitivity_curve(spark, sf_dir) -> DataFrame:
    """Eleven values of each feature that the record's report shows, and the prediction at
    each, all else unchanged."""
    rows, models = explained(spark, sf_dir)
    spread = exact_quantiles(rows, FEATURES, [0.1, 0.9, 1.0], ["segment"])
    at = {"low": 0.1, "high": 0.9, "top": 1.0}
    spread = spread.groupBy("segment", "feature").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in at.items()])
    ranges = spread.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct(*at)))).alias("ranges"))
    fitted = settle(models.drop("means").join(ranges, "segment"), "curve-models")
    scored = rows.join(fitted, "segment").withColumn("prediction", ex.predicted(FEATURES))
    shown = ex.exploded(ex.with_shown(scored, FEATURES).select(KEY, F.col("prediction").alias("now"), "ranges", "shown"), "shown", "s")
    own = F.col("ranges")[F.col("s.feature")]
    low, high = ex.curve_range(F.col("s.value"), own["low"], own["high"], own["top"])
    points = F.explode(F.sequence(F.lit(0), F.lit(10))).alias("point")
    grid = shown.select(KEY, "now", F.col("s.feature").alias("feature"), F.col("s.value").alias("x"), F.col("s.slope").alias("b"), low.cast("double").alias("low"), high.cast("double").alias("high"), points)
    value = F.col("low") + F.col("point") * (F.col("high") - F.col("low")) / 10
    return grid.select(
        KEY,
        "feature",
        "point",
        rounded(value).alias("value"),
        rounded(F.col("now") + F.col("b") * (value - F.col("x"))).alias("prediction"),
    )


# --- similar cases ------------------------------------------------------------------

DISTANCE = [*SPECIAL, *GENERAL, "driver_age", "vehicle_age", "days_to_claim", "total_damages"]
_Z = {c: f"(({c} - avg_{c}) / coalesce(nullif(sd_{c}, 0), 1))" for c in DISTANCE}
_SIMILAR = (
    "zs AS (SELECT segment, "
    + _n([f"avg({c}) AS avg_{c}, stddev_samp({c}) AS sd_{c}" for c in DISTANCE])
    + " FROM seg GROUP BY 1), z AS MATERIALIZED (SELECT claim_id, segment, "
    + _n([f"{_Z[c]} AS z{i}" for i, c in enumerate(DISTANCE)])
    + " FROM seg JOIN zs USING (segment)), nb AS MATERIALIZED (SELECT a.claim_id, min(struct_pack(d2 := round("
    + " + ".join(f"coalesce((a.z{i} - b.z{i}) * (a.z{i} - b.z{i}), 0)" for i in range(len(DISTANCE)))
    + """, 6), nb := b.claim_id), 5) AS top FROM z a JOIN z b ON a.segment = b.segment AND a.claim_id <> b.claim_id GROUP BY 1),
    sim AS MATERIALIZED (SELECT claim_id, rank AS neighbour_rank, top[rank].nb AS neighbour, sqrt(top[rank].d2) AS distance
      FROM nb, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS rank) WHERE rank <= len(top))"""
)


def _standardised(rows: DataFrame) -> DataFrame:
    """z-scores inside the segment, with the sample deviation; zero or none counts as 1."""
    stats = settle(
        rows.groupBy("segment").agg(
            *[F.avg(c).alias(f"avg_{c}") for c in DISTANCE],
            *[F.stddev_samp(c).alias(f"sd_{c}") for c in DISTANCE],
        ),
        "segment-scales",
    )
    scale = {
        c: (F.col(c) - F.col(f"avg_{c}")) / F.coalesce(F.nullif(F.col(f"sd_{c}"), F.lit(0.0)), F.lit(1.0))
        for c in DISTANCE
    }
    return rows.join(stats, "segment").select(KEY, "segment", *[v.alias(c) for c, v in scale.items()])


def _similar(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = settle(
        segmented(spark, sf_dir, *DISTANCE).select(
            KEY, "segment", "y", *[F.col(c).cast("double").alias(c) for c in DISTANCE], "total_special", "total_general"
        ),
        "similar-rows",
    )
    every = F.lit(True)
    return rows, nearest(
        _standardised(rows), KEY, DISTANCE, 5, "segment", asks=every, answers=every, axes=DISTANCE
    )


@query(
    "similar_cases",
    on_segments("SELECT claim_id, neighbour_rank, neighbour, round(distance, 4) AS distance FROM sim", _SIMILAR),
)
def similar_cases(spark, sf_dir) -> DataFrame:
    """The five nearest records of the same segment, for every record."""
    _, found = _similar(spark, sf_dir)
    return found.withColumn("distance", rounded(F.col("distance")))


SIDE = [*SPECIAL, *GENERAL, "total_special", "total_general", "y"]


@query(
    "similar_cases_compare",
    on_segments(
        """SELECT claim_id, feature, round(current_case, 4) AS current_case, """
        + _n([f"round(s{i}, 4) AS similar_{i}" for i in range(1, 6)])
        + " FROM (SELECT sim.claim_id, feature, "
        + _n([f"max(CASE WHEN neighbour_rank = {i} THEN v END) AS s{i}" for i in range(1, 6)])
        + " FROM sim JOIN lv ON lv.claim_id = neighbour GROUP BY 1, 2) JOIN (SELECT claim_id, feature, v AS current_case FROM lv) USING (claim_id, feature)",
        _SIMILAR,
        "lv AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT claim_id, '{c}' AS feature, {c} AS v FROM seg" for c in SIDE) + ")",
    ),
)
def similar_cases_compare(spark, sf_dir) -> DataFrame:
    """Damages and settlement of a record and of its neighbours, side by side."""
    rows, found = _similar(spark, sf_dir)
    facts = rows.select(F.col(KEY).alias("neighbour"), F.array(*SIDE).alias("facts"))
    wide = (
        found.join(facts, "neighbour")
        .groupBy(KEY)
        .agg(
            *[
                F.max(F.when(F.col("neighbour_rank") == i, F.col("facts"))).alias(f"n{i}")
                for i in range(1, 6)
            ]
        )
        .join(rows.select(KEY, F.array(*SIDE).alias("mine")), KEY)
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                rounded(F.col("mine")[j]).alias("current_case"),
                *[rounded(F.col(f"n{i}")[j]).alias(f"similar_{i}") for i in range(1, 6)],
            )
            for j, c in enumerate(SIDE)
        ]
    )
    return wide.select(KEY, F.explode(cells).alias("c")).select(KEY, "c.*")


@query(
    "knn_regression",
    on_base(
        """SELECT claim_id, round(coalesce(avg(y) FILTER (WHERE distance = 0),
          sum(CASE WHEN distance > 0 THEN y / distance END) / sum(CASE WHEN distance > 0 THEN 1 / distance END)), 4) AS prediction
        FROM (SELECT q AS claim_id, sqrt(t.d2) AS distance, t.y AS y FROM (SELECT q, unnest(top) AS t FROM kn)) GROUP BY 1""",
        _predictions_sql("split = 'train'"),
        "kn AS (SELECT a.claim_id AS q, min(struct_pack(d2 := round("
        + " + ".join(f"(a.{p} - b.{p}) * (a.{p} - b.{p})" for p in PREDICTIONS)
        + """, 6), nb := b.claim_id, y := b.y), 5) AS top
        FROM pr a JOIN pr b ON a.split = 'test' AND b.split = 'train' GROUP BY 1)""",
    ),
)
def knn_regression(spark, sf_dir) -> DataFrame:
    """Five neighbours among the training rows in the space of the base predictions,
    weighted by inverse distance."""
    rows = settle(
        predictions(base(spark, sf_dir, *BASE_COLUMNS), "split = 'train'").select(KEY, "y", "split", *PREDICTIONS),
        "knn-rows",
    )
    found = nearest(
        rows.withColumn("everyone", F.lit("all")),
        KEY,
        PREDICTIONS,
        5,
        "everyone",
        asks=F.col("split") == "test",
        answers=F.col("split") == "train",
        axes=PREDICTIONS,
    )
    with_y = found.join(rows.select(F.col(KEY).alias("neighbour"), "y"), "neighbour")
    return distance_weighted(with_y, KEY).select(KEY, rounded(F.col("prediction")).alias("prediction"))


# --- prediction summary -------------------------------------------------------------

_OTHER_TEXT = ["whiplash", "minor_psychological_injury", "injury_description", "vehicle_type"]
_OTHER_NUMBER = ["driver_age", "vehicle_age"]


def _summary_sql() -> str:
    parts = [f"SELECT claim_id, 'Original Input' AS section, '{c}' AS item, CAST(NULL AS DOUBLE) AS number, {c} AS text FROM t" for c in CRITERIA]
    parts += [f"SELECT claim_id, 'Special Damages', '{c}', {c}, NULL FROM t" for c in SPECIAL]
    parts += ["SELECT claim_id, 'Special Damages', 'total', s, NULL FROM t"]
    parts += [f"SELECT claim_id, 'General Damages', '{c}', {c}, NULL FROM t" for c in GENERAL]
    parts += ["SELECT claim_id, 'General Damages', 'total', g, NULL FROM t"]
    parts += ["SELECT claim_id, 'Damage Summary', 'total', s + g, NULL FROM t"]
    parts += ["SELECT claim_id, 'Damage Summary', 'special_general_ratio', CASE WHEN g > 0 THEN s / g END, CASE WHEN g > 0 THEN NULL ELSE 'N/A' END FROM t"]
    parts += [f"SELECT claim_id, 'Other Factors', '{c}', NULL, {c} FROM t" for c in _OTHER_TEXT]
    parts += [f"SELECT claim_id, 'Other Factors', '{c}', {c}, NULL FROM t" for c in _OTHER_NUMBER]
    return " UNION ALL ".join(parts)


@query(
    "prediction_summary",
    on_claims(
        _summary_sql(),
        """t AS (SELECT *, coalesce(special_care, 0) + coalesce(special_earnings, 0) + coalesce(special_medical, 0) AS s,
          coalesce(general_rest, 0) + coalesce(general_pain, 0) AS g FROM claims)""",
    ),
)
def prediction_summary(spark, sf_dir) -> DataFrame:
    """Every input of a record under its section, with totals and their ratio."""
    columns = [KEY, *CRITERIA, *SPECIAL, *GENERAL, *_OTHER_TEXT, *_OTHER_NUMBER]
    frame = claims(spark, sf_dir, columns).withColumns(
        {"s": row_total(SPECIAL), "g": row_total(GENERAL)}
    )
    none_number, none_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def cell(section, item, number=none_number, text=none_text):
        return F.struct(
            F.lit(section).alias("section"), F.lit(item).alias("item"), number.alias("number"), text.alias("text")
        )

    s, g = F.col("s"), F.col("g")
    cells = [cell("Original Input", c, text=F.col(c)) for c in CRITERIA]
    cells += [cell("Special Damages", c, F.col(c)) for c in SPECIAL] + [cell("Special Damages", "total", s)]
    cells += [cell("General Damages", c, F.col(c)) for c in GENERAL] + [cell("General Damages", "total", g)]
    cells += [
        cell("Damage Summary", "total", s + g),
        cell(
            "Damage Summary",
            "special_general_ratio",
            F.when(g > 0, s / F.when(g > 0, g)),
            F.when(g > 0, none_text).otherwise("N/A"),
        ),
    ]
    cells += [cell("Other Factors", c, text=F.col(c)) for c in _OTHER_TEXT]
    cells += [cell("Other Factors", c, F.col(c)) for c in _OTHER_NUMBER]
    return frame.select(KEY, F.explode(F.array(*cells)).alias("c")).select(KEY, "c.*")
