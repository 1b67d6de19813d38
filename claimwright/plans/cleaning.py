"""Sources, profiling, cleaning, encoding and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.hashing import fold_of
from claimwright.functions.numbers import rounded
from claimwright.functions.quantiles import quantile_values
from claimwright.operators import clean, profile, split
from claimwright.operators.segments import segment_single, shown
from claimwright.plans.base import base, hierarchy, segmented, written_claims
from claimwright.plans.registry import query
from claimwright.plans.sql import on_base, on_claims, on_segments, on_trimmed, FINITE
from claimwright.session import shared_path
from claimwright.sources.claims import CATEGORICAL, COLUMNS, KEY, NUMERIC, TARGET, claims
from claimwright.sources.tables import append_run, scan_claims, sink_metrics

TEXT_COLUMNS = ["exceptional_circumstances", "accident_type", "injury_description"]


@query(
    "scan_claims",
    on_claims(
        """SELECT claim_id, exceptional_circumstances, accident_type, whiplash,
        minor_psychological_injury, injury_description, vehicle_type,
        CAST(accident_date AS VARCHAR) AS accident_date, CAST(claim_date AS VARCHAR) AS claim_date,
        special_care, special_earnings, special_medical, general_rest, general_pain, driver_age, vehicle_age,
        CASE WHEN isfinite(settlement_value) THEN round(settlement_value, 4) END AS settlement_value,
        CASE WHEN settlement_value IS NULL THEN 'missing' WHEN isnan(settlement_value) THEN 'nan'
          WHEN isinf(settlement_value) THEN 'infinite' ELSE 'finite' END AS target_state FROM claims"""
    ),
)
def scan(spark, sf_dir) -> DataFrame:
    """Claims written as a table and scanned again with the declared schema."""
    path = shared_path(spark, "claims-scan")
    claims(spark, sf_dir).write.parquet(path)
    y = F.col(TARGET)
    state = (
        F.when(y.isNull(), "missing")
        .when(F.isnan(y), "nan")
        .when(F.abs(y) == float("inf"), "infinite")
        .otherwise("finite")
    )
    return scan_claims(spark, path).withColumns(
        {
            "accident_date": F.col("accident_date").cast("string"),
            "claim_date": F.col("claim_date").cast("string"),
            "target_state": state,
            TARGET: F.when(state == "finite", rounded(y)),
        }
    )


SEGMENT_SUMMARY = """SELECT segment, count(*) AS n, round(avg(y), 4) AS mean_y,
    round(stddev_samp(y), 4) AS std_y FROM seg GROUP BY segment"""


def _segment_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(shown(F.col("segment")).alias("segment")).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg("y")).alias("mean_y"),
        rounded(F.stddev_samp("y")).alias("std_y"),
    )


@query("sink_metrics", on_segments(SEGMENT_SUMMARY))
def sink(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "segment-metrics")
    sink_metrics(_segment_summary(segmented(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query(
    "run_log",
    on_segments(
        f"""SELECT r.run_id, segment AS model, metric, round(value, 4) AS value
        FROM (SELECT segment, unnest(['n', 'mean_y', 'std_y']) AS metric,
          unnest([CAST(n AS DOUBLE), mean_y, std_y]) AS value FROM ({SEGMENT_SUMMARY}))
        CROSS JOIN (VALUES ('run-1'), ('run-2')) r(run_id)"""
    ),
)
def run_log(spark, sf_dir) -> DataFrame:
    """Two runs appended to one log table."""
    path = shared_path(spark, "run-log")
    metrics = _segment_summary(segmented(spark, sf_dir))
    for run in ("run-1", "run-2"):
        append_run(metrics, path, run, key="segment")
    return spark.read.parquet(path).drop("run_ts")


@query(
    "table_shape",
    on_trimmed(
        """SELECT step, n_rows, CAST(17 AS BIGINT) AS n_columns FROM (
        SELECT 'all' AS step, count(*) AS n_rows FROM claims UNION ALL
        SELECT 'target_present', count(*) FROM claims
          WHERE settlement_value IS NOT NULL AND NOT isnan(settlement_value) UNION ALL
        SELECT 'target_finite', count(*) FROM finite UNION ALL
        SELECT 'outliers_trimmed', count(*) FROM trimmed)"""
    ),
)
def table_shape(spark, sf_dir) -> DataFrame:
    frame = written_claims(spark, sf_dir, [])
    threshold = clean.trim_threshold(clean.finite_target(frame, TARGET), TARGET)
    y = F.col(TARGET)
    return profile.table_shape(
        frame,
        {
            "all": F.lit(True),
            "target_present": y.isNotNull() & ~F.isnan(y),
            "target_finite": F.abs(y) < float("inf"),
            "outliers_trimmed": y <= threshold,
        },
        len(COLUMNS),
    )


_ALL = [KEY, *CATEGORICAL, "accident_date", "claim_date", *NUMERIC, TARGET]


@query(
    "missing_profile",
    on_claims(
        "SELECT column_name, n_missing FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL"
            + (f" OR isnan({c})" if c in [*NUMERIC, TARGET] else "")
            + ") AS n_missing FROM claims"
            for c in _ALL
        )
        + ") WHERE n_missing > 0"
    ),
)
def missing_profile(spark, sf_dir) -> DataFrame:
    return profile.missing_profile(claims(spark, sf_dir))


@query(
    "target_summary",
    on_trimmed(
        """SELECT count(*) AS n, round(avg(settlement_value), 4) AS mean_y,
        round(median(settlement_value), 4) AS median_y, round(min(settlement_value), 4) AS min_y,
        round(max(settlement_value), 4) AS max_y, round(stddev_samp(settlement_value), 4) AS std_y
        FROM trimmed"""
    ),
)
def target_summary(spark, sf_dir) -> DataFrame:
    kept = clean.quantile_trim(written_claims(spark, sf_dir, []), TARGET)
    median = quantile_values(kept, [TARGET], [0.5])[(TARGET, 0.5)]
    return kept.agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg(TARGET)).alias("mean_y"),
        rounded(F.lit(median)).alias("median_y"),
        rounded(F.min(TARGET)).alias("min_y"),
        rounded(F.max(TARGET)).alias("max_y"),
        rounded(F.stddev_samp(TARGET)).alias("std_y"),
    )


_TEXTS = [*CATEGORICAL, "accident_day"]


@query(
    "cardinality_profile",
    on_claims(
        "SELECT column_name, n_distinct, n_distinct > 20 AS too_many FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM c2" for c in _TEXTS
        )
        + ")",
        "c2 AS (SELECT *, CAST(accident_date AS VARCHAR) AS accident_day FROM claims)",
    ),
)
def cardinality_profile(spark, sf_dir) -> DataFrame:
    frame = claims(spark, sf_dir, [*CATEGORICAL, "accident_date"]).withColumn(
        "accident_day", F.col("accident_date").cast("string")
    )
    return profile.cardinality_profile(frame, _TEXTS)


@query(
    "segment_share",
    on_base(
        """SELECT exceptional_circumstances AS segment, count(*) AS n,
        round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM base GROUP BY 1"""
    ),
)
def segment_share(spark, sf_dir) -> DataFrame:
    sizes = segment_single(base(spark, sf_dir, "exceptional_circumstances"), "exceptional_circumstances").sizes()
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select(
        shown(F.col("segment")).alias("segment"),
        "n",
        rounded(F.lit(100.0) * F.col("n") / total).alias("share_pct"),
    )


@query(
    "target_histogram",
    on_segments(
        """SELECT segment, bin, count(*) AS n, round(lo + bin * (hi - lo) / 20, 4) AS bin_start FROM (
        SELECT segment, lo, hi, CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((y - lo) * 20 / (hi - lo)) END, 19) AS INTEGER) AS bin
        FROM seg JOIN (SELECT segment, min(y) AS lo, max(y) AS hi FROM seg GROUP BY 1) USING (segment))
        GROUP BY segment, bin, lo, hi"""
    ),
)
def target_histogram(spark, sf_dir) -> DataFrame:
    bins = profile.target_histogram(segmented(spark, sf_dir), "segment", "y")
    start = F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / 20
    return bins.select(
        shown(F.col("segment")).alias("segment"), "bin", "n", rounded(start).alias("bin_start")
    )


@query(
    "drop_missing_target",
    on_claims(
        """SELECT claim_id, isinf(settlement_value) AS infinite FROM claims
        WHERE settlement_value IS NOT NULL AND NOT isnan(settlement_value)"""
    ),
)
def drop_missing_target(spark, sf_dir) -> DataFrame:
    kept = clean.drop_missing_target(claims(spark, sf_dir, [KEY, TARGET]), TARGET)
    return kept.select(KEY, (F.abs(F.col(TARGET)) == float("inf")).alias("infinite"))


@query(
    "finite_target",
    on_claims("SELECT claim_id, round(settlement_value, 4) AS settlement_value FROM finite", FINITE),
)
def finite_target(spark, sf_dir) -> DataFrame:
    kept = clean.finite_target(claims(spark, sf_dir, [KEY, TARGET]), TARGET)
    return kept.select(KEY, rounded(F.col(TARGET)).alias(TARGET))


@query(
    "quantile_trim",
    on_trimmed("SELECT claim_id, round(settlement_value, 4) AS settlement_value FROM trimmed"),
)
def quantile_trim(spark, sf_dir) -> DataFrame:
    kept = clean.quantile_trim(claims(spark, sf_dir, [KEY, TARGET]), TARGET)
    return kept.select(KEY, rounded(F.col(TARGET)).alias(TARGET))


@query(
    "text_exclude",
    on_claims(
        """SELECT claim_id, accident_type FROM claims
        WHERE NOT regexp_matches(lower(accident_type), 'rare-[0-3]')"""
    ),
)
def text_exclude(spark, sf_dir) -> DataFrame:
    """The pattern hits no value of the first column, so the second one is filtered."""
    frame = claims(spark, sf_dir, [KEY, *TEXT_COLUMNS])
    return clean.text_exclude(frame, TEXT_COLUMNS, "RARE-[0-3]").select(KEY, "accident_type")


@query(
    "feature_projection",
    on_base(
        """SELECT claim_id, special_care, special_medical, total_damages, 0.0::DOUBLE AS pred_unseen,
        round(y, 4) AS y FROM base"""
    ),
)
def feature_projection(spark, sf_dir) -> DataFrame:
    wanted = ["special_care", "special_medical", "total_damages", "pred_unseen"]
    frame = base(spark, sf_dir, *wanted[:3]).withColumn("y", rounded(F.col("y")))
    return clean.feature_projection(frame, wanted, target="y", keep=[KEY])


_IMPUTED = ["special_care", "special_earnings", "special_medical", "general_rest", "general_pain",
            "driver_age", "vehicle_age"]


@query("median_impute", on_base(f"SELECT claim_id, {', '.join(_IMPUTED)} FROM imputed"))
def median_impute(spark, sf_dir) -> DataFrame:
    kept = clean.quantile_trim(written_claims(spark, sf_dir, NUMERIC), TARGET)
    return clean.impute(kept, clean.fit_medians(kept, NUMERIC)).select(KEY, *_IMPUTED)


_FOLD = "(claim_id * 2654435761) % 4294967296 % 5"


@query(
    "median_impute_fitted",
    on_claims(
        "SELECT claim_id, "
        + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _IMPUTED)
        + " FROM claims, m WHERE "
        + _FOLD
        + " = 0",
        "m AS (SELECT "
        + ", ".join(f"median({c}) AS m_{c}" for c in _IMPUTED)
        + f" FROM claims WHERE {_FOLD} <> 0)",
    ),
)
def median_impute_fitted(spark, sf_dir) -> DataFrame:
    """Medians of the training rows, applied to the test rows."""
    frame = written_claims(spark, sf_dir, NUMERIC).withColumn("split", split.holdout(F.col(KEY)))
    medians = clean.fit_medians(frame.where("split = 'train'"), NUMERIC)
    return clean.impute(frame.where("split = 'test'"), medians).select(KEY, *_IMPUTED)


@query(
    "constant_impute",
    on_claims(
        "SELECT claim_id, "
        + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in CATEGORICAL)
        + " FROM claims"
    ),
)
def constant_impute(spark, sf_dir) -> DataFrame:
    return clean.constant_impute(claims(spark, sf_dir, [KEY, *CATEGORICAL]), CATEGORICAL)


@query(
    "zero_fill",
    on_claims(
        """SELECT claim_id, coalesce(special_care, 0) AS special_care,
        coalesce(special_earnings, 0) AS special_earnings, coalesce(general_rest, 0) AS general_rest FROM claims"""
    ),
)
def zero_fill(spark, sf_dir) -> DataFrame:
    columns = ["special_care", "special_earnings", "general_rest"]
    return clean.zero_fill(claims(spark, sf_dir, [KEY, *columns]), columns)


@query(
    "drop_all_null_columns",
    on_base(
        """SELECT claim_id, CASE WHEN exceptional_circumstances = 'Yes' THEN total_damages END AS own_yes,
        CASE WHEN exceptional_circumstances = 'No' THEN total_damages END AS own_no FROM base"""
    ),
)
def drop_all_null_columns(spark, sf_dir) -> DataFrame:
    """A column for a segment that never occurs is left out."""
    own = {
        f"own_{v.lower()}": F.when(
            F.col("exceptional_circumstances") == v, F.col("total_damages")
        )
        for v in ("Yes", "No", "Withdrawn")
    }
    frame = base(spark, sf_dir, "exceptional_circumstances", "total_damages").withColumns(own).select(KEY, *own)
    return clean.drop_all_null_columns(frame, list(own))


@query(
    "standard_scale",
    on_base(
        "SELECT claim_id, "
        + ", ".join(
            f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) + 0.0 AS {c}"
            for c in [*_IMPUTED, "constant"]
        )
        + " FROM b2, st",
        "b2 AS (SELECT *, 1.0::DOUBLE AS constant FROM base)",
        "st AS (SELECT "
        + ", ".join(
            f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in [*_IMPUTED, "constant"]
        )
        + " FROM b2 WHERE split = 'train')",
    ),
)
def standard_scale(spark, sf_dir) -> DataFrame:
    columns = [*_IMPUTED, "constant"]
    frame = base(spark, sf_dir, *_IMPUTED).withColumn("constant", F.lit(1.0))
    scaler = clean.fit_scaler(frame.where("split = 'train'"), columns)
    return frame.select(KEY, *[rounded(clean.scaled(c, scaler), 6).alias(c) for c in columns])


@query(
    "one_hot",
    on_base(
        """SELECT claim_id,
        CASE WHEN vehicle_type = 'AUTOMOBILE' THEN 1 ELSE 0 END AS vehicle_type_AUTOMOBILE,
        CASE WHEN vehicle_type = 'BUILDING' THEN 1 ELSE 0 END AS vehicle_type_BUILDING,
        CASE WHEN vehicle_type = 'FURNITURE' THEN 1 ELSE 0 END AS vehicle_type_FURNITURE,
        CASE WHEN vehicle_type = 'HOUSEHOLD' THEN 1 ELSE 0 END AS vehicle_type_HOUSEHOLD,
        CASE WHEN vehicle_type = 'MACHINERY' THEN 1 ELSE 0 END AS vehicle_type_MACHINERY,
        CASE WHEN exceptional_circumstances = 'No' THEN 1 ELSE 0 END AS exceptional_circumstances_No,
        CASE WHEN exceptional_circumstances = 'Yes' THEN 1 ELSE 0 END AS exceptional_circumstances_Yes
        FROM base"""
    ),
)
def one_hot(spark, sf_dir) -> DataFrame:
    """Categories are learned where the circumstances are known; the imputed ``Unknown``
    is then a value not seen in training and encodes to zeros only."""
    frame = base(spark, sf_dir, "vehicle_type", "exceptional_circumstances")
    train = frame.where("split = 'train' AND exceptional_circumstances <> 'Unknown'")
    encoded = []
    for column in ("vehicle_type", "exceptional_circumstances"):
        encoded += clean.one_hot(column, clean.fit_categories(train, column))
    return frame.select(KEY, *encoded)


@query(
    "holdout_split",
    on_claims(f"SELECT claim_id, CASE WHEN {_FOLD} = 0 THEN 'test' ELSE 'train' END AS split FROM claims"),
)
def holdout_split(spark, sf_dir) -> DataFrame:
    frame = claims(spark, sf_dir, [KEY])
    return frame.select(KEY, split.holdout(F.col(KEY)).alias("split"))


@query("kfold_shuffled", on_claims(f"SELECT claim_id, CAST({_FOLD} AS INTEGER) AS fold FROM claims"))
def kfold_shuffled(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir, [KEY]).select(KEY, fold_of(F.col(KEY)).alias("fold"))


@query(
    "kfold_contiguous",
    on_claims(
        """SELECT claim_id, CASE WHEN claim_id > q[4] THEN 4 WHEN claim_id > q[3] THEN 3
        WHEN claim_id > q[2] THEN 2 WHEN claim_id > q[1] THEN 1 ELSE 0 END AS fold
        FROM claims, (SELECT quantile_cont(claim_id, [0.2, 0.4, 0.6, 0.8]) AS q FROM claims)"""
    ),
)
def kfold_contiguous(spark, sf_dir) -> DataFrame:
    return split.contiguous_folds(claims(spark, sf_dir, [KEY]), KEY)
