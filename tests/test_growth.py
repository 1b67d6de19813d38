"""Counting of joint bins, and where trees grow, at sizes above those of ``test_boosting``."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwright.operators import boosting as bo
from claimwright.operators import models as mo


@pytest.fixture(scope="module")
def binned():
    rng = np.random.default_rng(3)
    n = 60_000
    bins = np.stack([rng.integers(0, w, n) for w in (64, 64, 40, 2, 2, 7)]).astype(np.uint8)
    bins[1, rng.random(n) < 0.1] = bo.MISSING
    y = bins[0] * 1.0 + np.where(bins[3] > 0, 30.0, bins[2]) + rng.normal(size=n)
    return bins, y


def test_joint_bins_count_every_feature(binned):
    bins, y = binned
    paired = bo._paired(bins)
    assert len(paired) < len(bins) and sorted(f for own, _, _ in paired for f in own) == list(range(len(bins)))
    rows = np.flatnonzero(np.arange(len(y)) % 3)
    at, h = rows % 4, (rows % 5).astype(float)
    may = np.array([False, True, True, True, False, True])
    got = bo._paired_sums(paired, at, 4, y[rows], h, len(bins), may, rows)
    for f in range(len(bins)):
        for k, weight in enumerate((y[rows], h)):
            expected = np.zeros((4, bo.WIDTH))
            if f == 0 or may[f]:
                np.add.at(expected, (at, bins[f, rows]), weight)
            assert np.allclose(got[:, f, :, k], expected)


@pytest.mark.parametrize("growth", [bo.Growth(1, 0.3, 6, min_child=3), bo.Growth(1, depth=9, l2=0.0, forest=True)])
def test_the_larger_child_is_what_is_left(binned, growth, monkeypatch):
    """The same tree as with every node counted by itself, missing values and drawn rows included."""
    bins, y = binned
    weight = bo.row_weights({"hash": np.arange(len(y)) * 7919, "y": y}, bo.Lane(bo.Growth(forest=True)), 1)
    used = np.flatnonzero(weight)
    g, h = (-y * weight, weight) if growth.forest else (y.mean() - y, None)
    may = np.array([True, True, True, True, False, True])
    tree, leaf = bo._grown_alone(bins, g, h, growth, 0, may, None, used)
    monkeypatch.setattr(bo, "FEW_ROWS", len(y) + 1)
    plain, plain_leaf = bo._grown_alone(bins, g, h, growth, 0, may, None, used)
    assert sorted(zip(tree.feature, tree.cut, tree.h)) == sorted(zip(plain.feature, plain.cut, plain.h))
    assert np.allclose(tree.values(growth)[leaf], plain.values(growth)[plain_leaf])
    placed = tree.place(bins[:, used], np.zeros(len(used), np.int64), growth.depth)
    assert (placed == leaf).all()


def test_a_few_hundred_thousand_rows_grow_in_one_task(spark):
    """The number of jobs does not follow the trees."""
    df = spark.range(200_000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * F.col("b"))
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, growth):
        spark.sparkContext.setJobGroup(name, name)
        bo.fit_many(df, ["a", "b"], {"m": bo.Lane(growth)}, key="id")
        n = len(tracker.getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert jobs("two-trees", bo.Growth(2, 0.3, 3)) == jobs("six-trees", bo.Growth(6, 0.3, 3))
    assert jobs("two-drawn", bo.Growth(2, depth=3, forest=True)) == jobs("six-drawn", bo.Growth(6, depth=3, forest=True))


def test_blocks_of_many_rows_are_counted_jointly(binned):
    bins, y = binned
    block = {"hash": np.arange(len(y)), "y": y, "fold": np.zeros(len(y), np.int32), "segment": np.zeros(len(y), np.int32), "bins": bins, "predicted": np.full((1, len(y)), y.mean())}
    grown = bo._Open(0, 0, bo.Tree(1), 0, np.zeros(1, np.int64), np.ones(len(bins), bool), 0)
    for growth in (bo.Growth(), bo.Growth(subsample=0.5), bo.Growth(forest=True)):
        lane = bo.Lane(growth)
        weight = bo.row_weights(block, lane, 0)
        got = bo._block_sums(block, lane, grown, len(bins), bo._paired(bins))
        g = ((0 if growth.forest else y.mean()) - y) * weight
        for f in range(len(bins)):
            assert np.allclose(got[0, f, :, 0], np.bincount(bins[f], g, bo.WIDTH)) and np.allclose(got[0, f, :, 1], np.bincount(bins[f], weight, bo.WIDTH))


@pytest.mark.parametrize("depth", [5, 7])
def test_leaf_sets_reach_the_leaves(binned, depth):
    """Predictions and changed predictions as by walking down the trees, with segments and missing
    values; the walk is the only way for trees of more than 64 leaves."""
    bins, y = binned
    n = 4000
    x = np.where(bins[:, :n] == bo.MISSING, np.nan, bins[:, :n].astype(float))
    cuts = [np.arange(b[b < bo.MISSING].max()).astype(float) for b in bins]
    growth, segment, trees = bo.Growth(5, 0.4, depth, min_child=2), np.arange(n) % 2, []
    for k in range(growth.trees):
        tree = bo.Tree(3)  # the last segment has no row: a tree without splits
        for s in range(2):
            tree.graft(s, bo._grown_alone(bins[:, :n][:, segment == s], np.sin(y[:n] / (k + 2))[segment == s], None, growth, 0, np.ones(len(bins), bool))[0])
        trees.append(tree)
    model = bo.TreeModel([f"x{k}" for k in range(len(bins))], bo.asdict(growth), cuts, trees, np.array([1.0, 2.0, 3.0]), "s", ["a", "b", "c"])
    assert (model._sets() is None) == (depth > 6)

    def walked(x):
        return sum((model.value[model.leaves(x, segment, t)] for t in range(growth.trees)), model.base[segment])

    assert np.allclose(model.predict(x, segment), walked(x), atol=1e-12)
    assert model.predict(x[:, :1], np.array([2])).tolist() == [3.0]
    rng = np.random.default_rng(5)
    row, feature, value = rng.integers(0, n, 500), rng.integers(0, len(bins), 500), rng.integers(-2, 70, 500) / 1.5
    value[::9] = np.nan
    got = model.rescored(x, segment, row, feature, value)
    for i in range(len(row)):
        changed = x[:, row[i] : row[i] + 1].copy()
        changed[feature[i]] = value[i]
        assert abs(got[i] - model.predict(changed, segment[row[i] : row[i] + 1])[0]) < 1e-9


@pytest.mark.parametrize("local", [1 << 20, 500])
def test_a_large_forest_stays_on_the_cluster(spark, monkeypatch, local):
    """A forest above ``HELD_NODES`` predicts as one that the driver holds, and the driver gets no tree."""
    df = spark.range(0, 6000, 1, 4).selectExpr("id", "double(id % 97) AS a", "if(id % 11 = 0, NULL, double(id % 89)) AS b", "concat('n', id) AS name")
    df = df.withColumn("y", F.col("a") * F.coalesce("b", F.lit(7.0)))
    growth = bo.Growth(5, depth=12, l2=0.0, forest=True)
    held = growth.fit(df, ["a", "b"], key="id")
    monkeypatch.setattr(bo, "LOCAL_ROWS", local)
    monkeypatch.setattr(bo, "HELD_NODES", 1000)
    monkeypatch.setattr(bo.Tree, "graft", None) if local > 6000 else None
    stored = growth.fit(df, ["a", "b"], key="id")
    assert isinstance(stored, bo.StoredForest) and stored.trees.count() == 5
    scored = stored.transform(df)
    assert scored.columns == [*df.columns, "prediction"]
    got, expected = scored.orderBy("id").toPandas(), held.transform(df).orderBy("id").toPandas()
    assert (got["name"] == expected["name"]).all() and got["b"].isna().sum() == expected["b"].isna().sum()
    assert np.allclose(got["prediction"], expected["prediction"], rtol=1e-9)


@pytest.fixture(scope="module")
def many_segments():
    """A model of seven segments, the last without a split, with its rows and their segments."""
    rng = np.random.default_rng(5)
    segments, n = 7, 4000
    x = rng.normal(size=(5, n))
    x[2, rng.random(n) < 0.2], x[4] = np.nan, rng.integers(0, 3, n)
    segment = rng.integers(0, segments, n)
    y = np.where(np.isnan(x[2]), 3.0, x[0] * segment) + x[1]
    cuts = [np.unique(np.nanquantile(c, np.arange(1, 64) / 64)) for c in x]
    cuts = [own[own < np.nanmax(c)] for own, c in zip(cuts, x)]
    bins = np.stack([np.where(np.isnan(c), bo.MISSING, np.searchsorted(own, c, "left")) for c, own in zip(x, cuts)]).astype(np.uint8)
    growth, trees, predicted = bo.Growth(20, 0.3, 6), [], np.zeros(n)
    for _ in range(growth.trees):
        tree = bo.Tree(segments)
        for s in range(segments - 1):
            own = np.flatnonzero(segment == s)
            tree.graft(s, bo._grown_alone(np.ascontiguousarray(bins[:, own]), predicted[own] - y[own], None, growth, 0, np.ones(len(x), bool))[0])
        predicted += tree.values(growth)[tree.place(bins, segment, growth.depth)]
        trees.append(tree)
    return bo.TreeModel([f"f{k}" for k in range(len(x))], bo.asdict(growth), cuts, trees, np.zeros(segments), "s", list(range(segments))), x, segment


def test_leaf_sets_of_many_segments_reach_the_same_leaves(many_segments):
    model, x, segment = many_segments
    for own in (segment, np.full(len(segment), 2), np.full(len(segment), 6)):
        expected = [model.value[model.leaves(x, own, t)] for t in range(model.n_trees)]
        assert all((a == b).all() for a, b in zip(model.each_tree(x, own), expected, strict=True))


def test_leaf_sets_are_not_built_node_by_node(many_segments, monkeypatch):
    """Every task that scores builds them: steps follow depth and features, not nodes."""
    model, x, segment = many_segments
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    model._leaf_sets.clear(), getattr(model, "_leaf_tables", {}).clear()
    list(model.each_tree(x, segment))
    assert (model.feature >= 0).sum() > 2000 and len(calls) < 300


def test_rows_reach_a_growing_task_with_each_feature_side_by_side():
    """A feature whose bins lie apart is copied by every step that reads some of them."""
    rng = np.random.default_rng(2)
    bins, y, hashes = rng.integers(0, 64, (5, 900)).astype(np.uint8), rng.normal(size=900), rng.permutation(900) * 977
    pieces = [(bins[:, own], y[own], hashes[own]) for own in np.array_split(rng.permutation(900), 4)]
    got = bo._in_order(iter(pieces))
    order = np.argsort(hashes)
    assert got[0].flags.c_contiguous
    assert all((a == b).all() for a, b in zip(got, (bins[:, order], y[order], hashes[order]), strict=True))


@pytest.mark.parametrize("growth", [bo.Growth(1, 0.3, 6, min_child=3), bo.Growth(1, depth=10, l2=0.0, forest=True)])
def test_rows_moved_side_by_side_grow_the_same_tree(binned, growth, monkeypatch):
    bins, y = binned
    weight = bo.row_weights({"hash": np.arange(len(y)) * 7919, "y": y}, bo.Lane(bo.Growth(forest=True)), 1)
    used = np.flatnonzero(weight)
    g, h = (-y * weight, weight) if growth.forest else (y.mean() - y, None)
    may = np.ones(len(bins), bool)
    monkeypatch.setattr(bo, "FEW_ROWS", 16)
    trees = []
    for moved in (99, 1, 2, 3):
        monkeypatch.setattr(bo, "MOVED", moved)
        trees.append(bo._grown_alone(bins, g, h, growth, 0, may, None, used))
    for tree, leaf in trees[1:]:
        assert all((getattr(tree, c) == getattr(trees[0][0], c)).all() for c in ("feature", "cut", "left", "g", "h"))
        assert (leaf == trees[0][1]).all()


def test_forests_beside_boosters_do_not_keep_them_waiting():
    """The folds of a stack: no task has more work than a booster, which cannot be divided."""
    growths = [bo.Growth(200, depth=10, l2=0.0, forest=True), bo.Growth(200, 0.1, 5), bo.Growth(200, 0.1, 5)]
    models = [bo.Lane(g, k if k < 5 else None) for g in growths for k in range(6)]
    groups = [(m, 0) for m in range(len(models))]
    items = bo._items(models, groups, {g: 600_000 for g in groups}, 12)
    assert max((high - low) * models[m].growth.depth for m, _, low, high in items) <= 200 * 5
    for m in range(6):
        assert [k for i in sorted(i for i in items if i[0] == m) for k in range(i[2], i[3])] == list(range(200))


def test_a_solver_of_many_steps_waits_for_few_tasks(spark):
    rows = spark.range(0, 4000, 1, 16).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    rows = rows.withColumn("y", F.col("a") + 2 * F.col("b"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    mo.fit_on(rows, ["a", "b"], mo.elastic_net(0.01, 0.5, 70.0, rows=4000, solver="l-bfgs"))
    spark.sparkContext.setJobGroup("other", "other")
    stages = [s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
    tasks = sorted(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))
    assert tasks[len(tasks) // 2] == 1


def test_boosters_that_differ_in_the_least_child_part_where_it_matters(binned):
    bins, y = binned
    may, growth = np.ones(len(bins), bool), bo.Growth(1, 0.3, 5)
    twins = {1: bo.replace(growth, min_child=3.0), 2: bo.replace(growth, min_child=25_000.0)}
    tree, leaves = bo._grown_rows(bins, y.mean() - y, None, growth, 0, may, twins=twins)
    assert list(twins) == [1] and sorted(np.concatenate([own for _, own in leaves])) == list(range(len(y)))
    other = bo._grown_rows(bins, y.mean() - y, None, bo.replace(growth, min_child=3.0), 0, may)[0]
    assert all((getattr(tree, c) == getattr(other, c)).all() for c in ("feature", "cut", "left", "g", "h"))


def test_boosters_side_by_side_with_other_least_children_are_those_of_own_fits(spark):
    df = spark.range(0, 3000, 1, 3).selectExpr("id", "double(id % 97) AS a", "if(id % 11 = 0, NULL, double(id % 89)) AS b", "int(id % 3) AS f")
    df = df.withColumn("y", F.col("a") * F.coalesce("b", F.lit(7.0)))
    growths = {n: bo.Growth(6, 0.3, 4, min_child=n) for n in (1.0, 2.0, 150.0)}
    lanes = {f"{n}|{k}": bo.Lane(g, k) for n, g in growths.items() for k in range(2)}
    both = bo.fit_many(df, ["a", "b"], lanes, fold="f", key="id", marks=(2, 6))
    for name, lane in lanes.items():
        own = bo.fit_many(df, ["a", "b"], {"m": lane}, fold="f", key="id", marks=(2, 6))["m"]
        assert np.array_equal(own.value, both[name].value) and np.array_equal(own.threshold, both[name].threshold, equal_nan=True)
        assert own.left_out_r2 == pytest.approx(both[name].left_out_r2, abs=1e-12)
    assert not np.array_equal(both["1.0|0"].value, both["150.0|0"].value)


def test_rows_of_several_times_a_small_task_do_not_wait_at_every_level(spark, monkeypatch):
    monkeypatch.setattr(bo, "LOCAL_ROWS", 20_000)
    monkeypatch.setattr(bo, "READ_ROWS", 10_000, raising=False)
    df = spark.range(100_000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * F.col("b"))
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, trees):
        spark.sparkContext.setJobGroup(name, name)
        bo.fit_many(df, ["a", "b"], {"m": bo.Lane(bo.Growth(trees, 0.3, 3))}, key="id")
        n = len(tracker.getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    assert jobs("large-two", 2) == jobs("large-six", 6)


def test_counting_takes_some_rows_at_a_time(binned, monkeypatch):
    """The same sums as at once, with nothing made that is as long as all rows."""
    bins, y = binned
    may, paired, rows = np.ones(len(bins), bool), bo._paired(bins), np.arange(0, len(y), 3, dtype=np.int32)
    at_once = bo._paired_sums(paired, None, 1, y[rows], None, len(bins), may, rows)
    monkeypatch.setattr(bo, "STEP_ROWS", 1000)
    longest, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: longest.append(len(x)) or count(x, *a))
    got = bo._paired_sums(paired, None, 1, y, None, len(bins), may, rows, True)
    assert np.allclose(got, at_once) and max(longest) < len(rows)


def test_the_best_point_of_a_grid_is_fitted_beside_the_folds(spark, monkeypatch):
    from claimwright.plans import tree_models as tm

    df = spark.range(0, 3000, 1, 3).selectExpr("id AS claim_id", "double(id % 97) AS a", "if(id % 11 = 0, NULL, double(id % 89)) AS b", "int(id % 5) AS inner_fold")
    df = df.withColumn("y", F.col("a") * F.coalesce("b", F.lit(7.0)))
    fits, fit = [], tm.fit_many
    monkeypatch.setattr(tm, "fit_many", lambda *a, **k: fits.append(1) or fit(*a, **k))
    rows, model = tm.searched_and_fitted(df, ["a", "b"], {"rate": (0.1, 0.3), "depth": (2, 3)}, (3, 6))
    assert len(fits) == 1 and rows == tm.grid_search(df, ["a", "b"], {"rate": (0.1, 0.3), "depth": (2, 3)}, (3, 6))
    for trees in (3, 6):
        own = fit(df, ["a", "b"], {"m": bo.Lane(mo.boosted_trees(trees, rate=rows[0]["rate"], depth=rows[0]["depth"]))}, key="claim_id")["m"]
        got = model.first(trees) if trees < model.n_trees else model
        if got.n_trees == trees:
            assert np.array_equal(own.value, got.value) and own.growth == got.growth
            assert [r[0] for r in own.transform(df).orderBy("claim_id").select("prediction").collect()] == [r[0] for r in got.transform(df).orderBy("claim_id").select("prediction").collect()]


def test_trees_of_many_leaves_are_walked_by_bins(binned, monkeypatch):
    """The same leaves as by values, missing ones and those beyond the last cut included."""
    bins, y = binned
    x = np.where(bins == bo.MISSING, np.nan, bins.astype(float))[:, :5000]
    cuts, growth = [np.arange(b[b < bo.MISSING].max()).astype(float) for b in bins], bo.Growth(4, depth=9, l2=0.0, forest=True)
    trees = [bo._grown_alone(bins, -np.cos(y / (k + 3)), np.ones(len(y)), growth, 0, np.ones(len(bins), bool))[0] for k in range(growth.trees)]
    model, segment = bo.TreeModel([f"x{k}" for k in range(len(bins))], bo.asdict(growth), cuts, trees, np.zeros(1), None, [None]), np.zeros(5000, np.int64)
    expected = [model.value[model.leaves(x, segment, t)] for t in range(model.n_trees)]
    monkeypatch.setattr(bo.TreeModel, "leaves", None)
    assert all((a == b).all() for a, b in zip(model.each_tree(x, segment), expected, strict=True))


def test_candidate_segmentations_of_a_large_table_grow_in_one_fit(spark, monkeypatch):
    """One fit for all of six candidates over nine million rows: each alone waits for its largest segment."""
    from claimwright.operators import unified as un

    df = spark.range(0, 400, 1, 2).selectExpr("id AS claim_id", "double(id % 97) AS a", "concat('s', id % 2) AS c", "concat('t', id % 3) AS d", "if(id % 5 = 0, 'test', 'train') AS split")
    df = df.withColumn("y", F.col("a") * 2.0)
    fits, fit = [], un.boosted_per_segment
    monkeypatch.setattr(un, "boosted_per_segment", lambda *a, **k: fits.append(1) or fit(*a, **k))
    monkeypatch.setattr(un, "SEARCH_ROWS", un.SEARCH_ROWS * 400 // 9_000_000)  # as for so many rows
    found = un.boosted_segmentations(df, {c: un.segment_composite(df, [c], 10) for c in ("c", "d")}, ["a"], bo.Growth(2, 0.3, 2))
    assert len(fits) == 1 and found.count() == 2
