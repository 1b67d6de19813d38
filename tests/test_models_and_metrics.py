import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from claimwright.operators import ensembles as en
from claimwright.operators import metrics as me
from claimwright.operators import models as mo
from claimwright.operators.linear import ALL_FOLDS, fit_linear

# Published segment results (R², RMSE, rows) and their weighted means.
SEGMENT_RESULTS = [
    (1.000000, 0.30, 61), (0.999991, 2.65, 135), (0.999770, 10.11, 78), (0.999713, 15.31, 84),
    (0.998908, 23.33, 176), (0.998481, 38.77, 94), (0.998297, 31.49, 224), (0.997612, 50.16, 67),
    (0.997553, 39.50, 151), (0.995740, 51.52, 254), (0.988350, 102.30, 300), (0.983380, 115.31, 525),
    (0.974927, 123.64, 2303), (0.969290, 169.64, 95), (0.965330, 154.58, 245), (0.938761, 212.92, 97),
]
WEIGHTED = (0.981655665494652, 100.28263383470549, 4889)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1.0, 50.0, 0.0] + [0.0, 1000.0, 5.0]
    y = 7.0 + 2.0 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=600)
    group = np.arange(600) % 3
    rows = [(int(i), *map(float, x[i]), float(y[i]), f"g{group[i]}", int(i % 5)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, g string, f int"), x, y, group


def closed_form(x, y, l2=0.0):
    xc, yc = x - x.mean(0), y - y.mean()
    slopes = np.linalg.pinv(xc.T @ xc + l2 * np.eye(x.shape[1])) @ xc.T @ yc
    return y.mean() - slopes @ x.mean(0), slopes


def test_grouped_fits_equal_closed_form_with_constant_feature(sample):
    df, x, y, group = sample
    for row in fit_linear(df, ["a", "b", "c"], "y", ["g"], l2=0.5).table.where("fold = -1").collect():
        mine = group == int(row["g"][1])
        intercept, slopes = closed_form(x[mine], y[mine], 0.5)
        assert row["intercept"] == pytest.approx(intercept, rel=1e-6)
        assert row["slopes"] == pytest.approx(list(slopes), abs=1e-8)


def test_leave_one_fold_out_equals_a_separate_fit(sample):
    df, x, y, _ = sample
    models = fit_linear(df, ["a", "b"], "y", fold="f")
    fold = np.arange(600) % 5
    for row in models.table.collect():
        kept = fold != row["fold"] if row["fold"] != ALL_FOLDS else np.ones(600, bool)
        intercept, slopes = closed_form(x[kept, :2], y[kept])
        assert row["intercept"] == pytest.approx(intercept, rel=1e-8)
        assert row["slopes"] == pytest.approx(list(slopes), rel=1e-8)
    scored = models.predict(df.withColumn("fold", F.col("f")), "p", out_of_fold=True)
    assert scored.where("p IS NOT NULL").count() == 600


@pytest.mark.parametrize("solver", ["normal", "l-bfgs"])
def test_ridge_and_elastic_net_mapping(sample, solver):
    df, x, y, _ = sample
    n, deviation = mo.target_deviation(df, "y")
    if solver == "l-bfgs":
        deviation *= (n / (n - 1)) ** 0.5
    fitted = mo.fit_on(df, ["a", "b"], mo.ridge(30.0, n, deviation).setSolver(solver)).stages[-1]
    intercept, slopes = closed_form(x[:, :2], y, 30.0)
    assert fitted.intercept == pytest.approx(intercept, rel=1e-5)
    assert list(fitted.coefficients) == pytest.approx(list(slopes), rel=1e-5)

    net = mo.fit_on(df, ["a", "b"], mo.elastic_net(0.2, 0.5, deviation).setSolver(solver)).stages[-1]
    b = np.array(net.coefficients)
    xc, yc = x[:, :2] - x[:, :2].mean(0), y - y.mean()
    gradient = xc.T @ (xc @ b - yc) / n + 0.1 * b + 0.1 * np.sign(b)
    assert np.abs(gradient).max() < 1e-3


def test_least_squares_equal_pyspark(sample):
    df, *_ = sample
    ours = fit_linear(df, ["a", "b"], "y").only()
    theirs = mo.fit_on(df, ["a", "b"], LinearRegression(labelCol="y", solver="normal")).stages[-1]
    assert ours["intercept"] == pytest.approx(theirs.intercept)
    assert ours["slopes"] == pytest.approx(list(theirs.coefficients))


def test_weighted_metrics_reproduce_published_means(spark):
    df = spark.createDataFrame(SEGMENT_RESULTS, "r2 double, rmse double, n long")
    row = me.weighted_metrics(df, "n", names=("r2", "rmse")).first()
    assert row["r2"] == pytest.approx(WEIGHTED[0], abs=1e-6)
    assert row["rmse"] == pytest.approx(WEIGHTED[1], abs=0.01)
    assert row["n_total"] == WEIGHTED[2]


def test_gains_and_tiers(spark):
    rows = [("base", 0.8764, 298.87), ("best", 0.9085, 248.32), ("worse", 0.6875, 460.50), ("near", 0.9, 290.0)]
    df = me.against_baseline(spark.createDataFrame(rows, "model string, r2 double, rmse double"), "base")
    got = {r["model"]: r for r in df.withColumn("tier", me.recommendation_tier(F.col("r2_gain_pct"))).collect()}
    assert got["best"]["r2_gain_pct"] == pytest.approx(3.67, abs=0.02)
    assert got["worse"]["r2_gain_pct"] == pytest.approx(-21.55, abs=0.02)
    assert got["best"]["rmse_gain_pct"] == pytest.approx(16.91, abs=0.01)
    assert [got[m]["tier"] for m in ("best", "worse", "near")] == ["moderate", "minimal", "moderate"]


def test_metrics_of_a_constant_or_single_row_segment(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("t", 3.0, 1.0), ("t", 3.0, 5.0)], "k string, y double, prediction double")
    got = {r["k"]: r for r in me.regression_metrics(df, ["k"]).collect()}
    assert got["s"]["r2"] is None and got["s"]["mse"] == 1.0
    assert got["t"]["r2"] is None and got["t"]["mae"] == 2.0


def test_vote_weights_sum_to_one_and_ignore_bad_models(spark):
    df = spark.createDataFrame([(1.0, 1.1, 9.0), (2.0, 2.1, -9.0), (3.0, 2.9, 9.0)], "y double, good double, bad double")
    weights = en.vote_weights(df, ["good", "bad"])
    assert sum(weights.values()) == pytest.approx(1.0) and weights["bad"] == 0.0


def test_row_mean_and_fallback(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = df.select(
        en.row_mean(["a", "b"]).alias("m"), en.with_fallback(F.col("a"), F.col("b"), 9.0).alias("f")
    ).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (None, 9.0)]
