"""Registered queries against their SQL twins on the smallest tables.

All of them run with CLAIMWRIGHT_ALL_QUERIES=1; by default one or two of each family."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

DEFAULT = """scan_claims table_shape missing_profile quantile_trim median_impute_fitted one_hot kfold_contiguous
claim_delay_coerced segment_composite segment_hierarchical segmentation_search elastic_net per_segment_models
segment_mean_fallback stacking meta_features_wide voting_weighted segment_metrics improvement_pct contributions
diverse_top_features sensitivity_screen similar_cases knn_regression prediction_summary score_stream""".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("CLAIMWRIGHT_ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"segment", "n", "mse", "rmse", "mae", "r2"}


def test_contributions_add_up(spark, sf_dir):
    from pyspark.sql import functions as F

    table = entry.queries()["contributions"](spark, sf_dir)
    steps = table.groupBy("claim_id").agg(
        F.sum("contribution").alias("total"),
        F.max_by("running_total", "place").alias("last"),
        F.min_by(F.col("running_total") - F.col("contribution"), "place").alias("start"),
    )
    assert steps.where("abs(start + total - last) > 0.01").count() == 0
