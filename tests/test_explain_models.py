"""Explanations of boosters against scoring changed rows one by one; the radial machine against an exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwright.operators import boosting as bo
from claimwright.operators import explain as ex
from claimwright.operators import rbf
from claimwright.operators.unified import FittedSegmentedModel, UnifiedSegmentedModel
from claimwright.plans import explain_models as em
from claimwright.session import settle, shared_path
from claimwright.sources.claims import KEY, claims
from claimwright.streaming.score import score_stream


@pytest.fixture(scope="module")
def boosted(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "s" + str(k % 2), *map(float, rng.integers(0, 50, 3)), float(rng.normal() * 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, segment string, special_a double, driver_age double, whiplash_flag double, noise double")
    df = df.withColumn("y", F.col("special_a") * 9 + F.col("driver_age") * F.when(F.col("segment") == "s0", 3.0).otherwise(-3.0) + F.col("noise"))
    df = settle(df, "boosted")
    names = ["special_a", "driver_age", "whiplash_flag"]
    model = bo.fit_many(df, names, {"m": bo.Lane(bo.Growth(20, 0.2, 3))}, segment="segment")["m"]
    return df, names, model


def test_what_if_equals_scoring_changed_rows(boosted):
    df, names, model = boosted
    numbered = bo.with_segment_number(df, "segment", model.segments)
    which = F.array(F.lit(1), F.lit(0))
    values = F.array(F.array(F.col("driver_age") * 2, F.lit(7.0)), F.array(F.lit(0.0), F.lit(30.0), F.col("special_a")))
    got = {r["id"]: r["w"] for r in numbered.select("id", model.what_if(which, values).alias("w")).collect()}
    changed = [
        df.withColumn("driver_age", F.col("driver_age") * 2), df.withColumn("driver_age", F.lit(7.0)),
        df.withColumn("special_a", F.lit(0.0)), df.withColumn("special_a", F.lit(30.0)), df,
    ]
    for (i, j), other in zip([(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)], changed):
        for r in model.transform(other).select("id", "prediction").collect():
            assert abs(got[r["id"]][i][j] - r["prediction"]) < 1e-9


def test_slopes_of_model_move_the_prediction(boosted):
    df, names, model = boosted
    numbered = bo.with_segment_number(df, "segment", model.segments).withColumn("prediction", model.prediction())
    rows = ex.slopes_of_model(numbered, model, names).withColumn("importances", F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))
    low, high = ex.test_values(F.col("special_a"))
    expected = {}
    for name, c in (("low", low), ("high", high)):
        expected[name] = {r["id"]: r["prediction"] for r in model.transform(df.withColumn("special_a", c.cast("double"))).collect()}
    found = ex.screened(rows, "id", names).where("feature = 'special_a'").collect()
    assert len(found) > 300
    for r in found:
        assert abs(r["change"] - abs(expected["high"][r["id"]] - expected["low"][r["id"]])) < 1e-6


def test_shown_features_are_found_once(boosted):
    df, names, model = boosted
    numbered = bo.with_segment_number(df, "segment", model.segments).withColumn("prediction", model.prediction())
    rows = settle(ex.slopes_of_model(numbered, model, names).withColumn("importances", F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))), "slopes")
    plan = ex.diverse(rows, "id", names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1


def test_exact_kernel_machine(spark):
    """With all rows as landmarks the optimum of the objective is reached: no random step and no
    step along the gradient makes it lower."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (150, 2))
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] + rng.normal(size=150) * 0.2
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    model = rbf.fit_rbf(df, ["a", "b"], gamma=0.7)
    phi = model.features(x)

    def loss(w):
        return w[:-1] @ w[:-1] / 2 + np.maximum(np.abs(y - phi @ w) - 0.1, 0).sum()

    own = loss(model.weights)
    # A plain solver: subgradient steps with the best value kept.
    w, best = model.weights.copy(), own
    for k in range(4000):
        rest = y - phi @ w
        g = np.append(w[:-1], 0.0) - phi.T @ (np.sign(rest) * (np.abs(rest) > 0.1))
        w = w - g * 0.02 / np.sqrt(1 + k) / max(np.linalg.norm(g), 1e-9)
        best = min(best, loss(w))
    assert own <= best * 1.002
    few = rbf.fit_rbf(df, ["a", "b"], gamma=0.7, landmarks=60)
    grid = rng.uniform(-2, 2, (300, 2))
    truth = np.sin(2 * grid[:, 0]) * 3 + grid[:, 1]
    errors = [np.abs(m.predict(grid) - truth).mean() for m in (model, few)]
    assert errors[0] < 0.25 and errors[1] < errors[0] * 1.2
    scored = few.transform(df).select("a", "b", "prediction").collect()
    assert np.allclose([r["prediction"] for r in scored], few.predict(np.array([[r["a"], r["b"]] for r in scored])))


def test_radial_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (1.0, 2.0, 5.0), (None, 2.0, 7.0)], "a double, b double, y double")
    assert rbf.fit_rbf(df, ["a", "b"]).transform(df).where("prediction is null or isnan(prediction)").count() == 0
    assert rbf.fit_rbf(df.where("a > 9"), ["a", "b"]).transform(df).select("prediction").first()[0] == 0


def test_stream_of_the_loaded_unified_model_equals_its_batch(spark, sf_dir):
    raw = settle(claims(spark, sf_dir), "unified-stream")
    model = UnifiedSegmentedModel(trees=3, folds=2).fit(raw)
    path, source, sink = shared_path(spark, "unified"), shared_path(spark, "in"), shared_path(spark, "out")
    model.save(path)
    loaded = FittedSegmentedModel.load(spark, path)
    raw.repartition(4).write.parquet(source)
    score_stream(spark, source, raw.schema, lambda df: loaded.transform(df).select(KEY, "segment", "prediction"), sink, shared_path(spark, "state"), 2).awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = model.transform(raw).select(KEY, F.col("segment").alias("own"), F.col("prediction").alias("batch"))
    assert streamed.count() == raw.count()
    assert streamed.join(batch, KEY).where("segment = own and abs(prediction - batch) < 1e-9").count() == raw.count()
    weights = loaded.weights().collect()
    assert [r["place"] for r in weights] == [1, 2, 3] and abs(sum(r["share"] for r in weights) - 1) < 1e-9


@pytest.mark.parametrize("name", ["sensitivity_screen_boosted", "sensitivity_curve_boosted", "contributions_boosted"])
def test_queries(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(em, "TREES", 5)
    got = em.query.__globals__["QUERIES"][name](spark, sf_dir)
    assert got.count() > 100 and got.where(" or ".join(f"{c} is null" for c in got.columns)).count() == 0
