"""Histogram boosters against a plain version, side by side and one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwright.operators import boosting as bo
from claimwright.session import settle, shared_path


def plain_boost(x, y, growth, cuts, may=None):
    """Exhaustive second-order boosting over the same cuts; NaN is missing. Returns a scorer."""
    may = np.ones(x.shape[1], bool) if may is None else may
    base = y.mean()
    fitted, trees = np.full(len(y), base), []

    def score(g, h):
        return g * g / (h + growth.l2)

    def grow(rows, g, depth):
        total = g[rows].sum()
        best = None
        for f in np.flatnonzero(may) if depth else []:
            v = x[rows, f]
            for missing_left in (False, True):
                for cut in [*cuts[f], np.inf]:  # the last tells present from missing values
                    left = (v <= cut) | (missing_left & np.isnan(v))
                    if min(left.sum(), (~left).sum()) < max(growth.min_child, 1):
                        continue
                    gl = g[rows[left]].sum()
                    gain = 0.5 * (score(gl, left.sum()) + score(total - gl, (~left).sum()) - score(total, len(rows))) - growth.min_gain
                    if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                        best = gain, f, cut, missing_left, left
        if best is None or best[0] <= 1e-12:
            return -total / (len(rows) + growth.l2) * growth.rate
        _, f, cut, missing_left, left = best
        return f, cut, missing_left, grow(rows[left], g, depth - 1), grow(rows[~left], g, depth - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            f, cut, missing_left, a, b = tree
            tree = a if (missing_left if np.isnan(row[f]) else row[f] <= cut) else b
        return tree

    for _ in range(growth.trees):
        tree = grow(np.arange(len(y)), fitted - y, growth.depth)
        trees.append(tree)
        fitted = fitted + np.array([value(tree, row) for row in x])
    return lambda rows: base + sum(np.array([value(t, r) for r in rows]) for t in trees)


@pytest.fixture(autouse=True, params=["by levels", "alone"])
def way(request, monkeypatch):
    """Both ways to grow: all tasks at every level, and each group of rows in one task."""
    if request.param == "by levels":
        monkeypatch.setattr(bo, "LOCAL_ROWS", 0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 700
    a, b, c = rng.integers(0, 9, n).astype(float), rng.normal(size=n).round(1), rng.uniform(0, 100, n)
    y = 3 * a + np.where(b > 0, 10.0, 0.0) * (a > 4) + np.sqrt(c) + rng.normal(size=n)
    b[rng.random(n) < 0.2] = np.nan
    y[np.isnan(b)] -= 6
    rows = [(k, *map(float, r), k % 5, "s" + str(k % 3)) for k, r in enumerate(zip(a, b, c, y))]
    df = settle(spark.createDataFrame(rows, "id long, a double, b double, c double, y double, f int, seg string").repartition(3, "id"), "boosting")
    return df, np.stack([a, b, c], 1), y


FEATURES = ["a", "b", "c"]


def predictions(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()])


def test_equals_the_plain_version(table):
    df, x, y = table
    growth = bo.Growth(6, 0.3, 3, min_child=4, l2=1.5, min_gain=0.1)
    model = growth.fit(df, FEATURES)
    assert np.allclose(predictions(model, df), plain_boost(x, y, growth, model.cuts)(x), atol=1e-9)
    # Missing values were worth learning about.
    assert model.missing_left.any()
    shares = model.importances()
    assert abs(shares.sum() - 1) < 1e-9 and (shares > 0).all()


def test_folds_and_combinations_grow_side_by_side(table):
    df, x, y = table
    lanes = {f"{k}|{d}": bo.Lane(bo.Growth(4, 0.5, d), k) for k in (0, 3, None) for d in (2, 4)}
    fitted = bo.fit_many(df, FEATURES, lanes, fold="f")
    fold = np.arange(len(y)) % 5
    for name, lane in lanes.items():
        seen = np.ones(len(y), bool) if lane.left_out is None else fold != lane.left_out
        expected = plain_boost(x[seen], y[seen], lane.growth, fitted[name].cuts)(x)
        assert np.allclose(predictions(fitted[name], df), expected, atol=1e-9)


@pytest.mark.parametrize("direct", [0, 1 << 30])
def test_segments_grow_side_by_side(table, direct, monkeypatch):
    """As many jobs for one segment as for three; each segment's trees are its own."""
    monkeypatch.setattr(bo, "DIRECT_BYTES", direct)
    monkeypatch.setattr(bo, "RANGE", 2)
    df, x, y = table
    chosen = np.array([[True, True, True], [True, False, True], [False, True, True]])
    growth = bo.Growth(3, 0.5, 3)
    tracker = df.sparkSession.sparkContext.statusTracker()

    def jobs(name, **more):
        df.sparkSession.sparkContext.setJobGroup(name, name)
        model = bo.fit_many(df, FEATURES, {"m": bo.Lane(growth)}, key="id", **more)["m"]
        n = len(tracker.getJobIdsForGroup(name))
        df.sparkSession.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return model, n

    model, several = jobs(f"three{direct}", segment="seg", segments=["s0", "s1", "s2"], chosen=chosen)
    _, one = jobs(f"one{direct}", segment="seg", segments=["s0"])
    assert several == one
    got = predictions(model, df)
    for s in range(3):
        own = np.arange(len(y)) % 3 == s
        expected = plain_boost(x[own], y[own], growth, model.cuts, chosen[s])(x[own])
        assert np.allclose(got[own], expected, atol=1e-9)
    assert model.transform(df.withColumn("seg", F.lit("other"))).where("prediction is not null").count() == 0


def test_samples_do_not_hang_on_partitions(table):
    df, _, _ = table
    growth = bo.Growth(5, 0.3, 3, subsample=0.7, column_share=0.7)
    one, other = growth.fit(df.coalesce(1), FEATURES, key="id"), growth.fit(df.repartition(7, "a"), FEATURES, key="id")
    assert np.allclose(predictions(one, df), predictions(other, df), atol=1e-6)


def test_forest_is_a_mean_of_drawn_trees(table):
    df, x, y = table
    forest = bo.Growth(40, depth=6, l2=0.0, forest=True)
    model = forest.fit(df, FEATURES, key="id")
    got = predictions(model, df)
    assert model.n_trees == 40 and 1 - ((got - y) ** 2).mean() / y.var() > 0.9
    weights = np.concatenate([bo.row_weights({"hash": np.arange(2000) * 7919, "y": np.zeros(2000)}, bo.Lane(forest), k) for k in range(20)])
    assert abs(weights.mean() - 1) < 0.03 and abs(weights.var() - 1) < 0.05


@pytest.mark.parametrize("local", [0, 200, 1 << 16])
def test_forest_trees_do_not_hang_on_where_they_are_finished(table, local, monkeypatch):
    """Grown by levels, half by levels, and in one task each: the same trees, missing values and
    segments included."""
    df, x, y = table
    forest = bo.Growth(6, depth=5, l2=0.0, forest=True, column_share=0.7)
    expected = predictions(bo.fit_many(df, FEATURES, {"m": bo.Lane(forest, 2)}, fold="f", segment="seg", key="id")["m"], df)
    monkeypatch.setattr(bo, "LOCAL_ROWS", local)
    monkeypatch.setattr(bo, "SENT_BYTES", 60_000)
    got = predictions(bo.fit_many(df, FEATURES, {"m": bo.Lane(forest, 2)}, fold="f", segment="seg", key="id")["m"], df)
    assert np.allclose(got, expected, atol=1e-6)


def test_left_out_r2_is_that_of_the_fold(table):
    df, x, y = table
    model = bo.fit_many(df, FEATURES, {"m": bo.Lane(bo.Growth(6, 0.3, 3), 2)}, fold="f", marks=(3, 6))["m"]
    own = np.arange(len(y)) % 5 == 2
    got = predictions(model, df)[own]
    assert sorted(model.left_out_r2) == [3, 6] and model.left_out_r2[3] < model.left_out_r2[6]
    assert abs(model.left_out_r2[6] - (1 - ((got - y[own]) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum())) < 1e-9


def test_staged_metrics_are_those_of_prefixes(table):
    df, x, y = table
    model = bo.Growth(8, 0.3, 3).fit(df, FEATURES)
    stages = {r["trees"]: r for r in model.staged_metrics(df).collect()}
    assert sorted(stages) == list(range(9)) and abs(stages[0]["r2"]) < 1e-9
    last = ((predictions(model, df) - y) ** 2).mean()
    assert abs(stages[8]["mse"] - last) < 1e-9
    first = bo.Growth(3, 0.3, 3).fit(df, FEATURES)
    assert abs(stages[3]["mse"] - ((predictions(first, df) - y) ** 2).mean()) < 1e-9


def test_saved_model_predicts_the_same(spark, table):
    df, _, _ = table
    model = bo.fit_many(df, FEATURES, {"m": bo.Lane(bo.Growth(4, 0.3, 3))}, segment="seg")["m"]
    path = shared_path(spark, "booster")
    model.save(spark, path)
    assert (predictions(bo.TreeModel.load(spark, path), df) == predictions(model, df)).all()


def test_edges(spark):
    schema = "id long, a double, y double"
    one = spark.createDataFrame([(1, 2.0, 5.0)], schema)
    assert predictions(bo.Growth(3).fit(one, ["a"]), one).tolist() == [5.0]
    nothing = spark.createDataFrame([(1, None, 5.0), (2, None, 7.0)], schema)
    assert predictions(bo.Growth(3).fit(nothing, ["a"]), nothing).tolist() == [6.0, 6.0]
    empty = one.where("id < 0")
    assert predictions(bo.Growth(3).fit(empty, ["a"]), one).tolist() == [0.0]
