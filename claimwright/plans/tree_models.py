"""Spark ML models. Their numbers have no SQL form; tests check their invariants."""

from __future__ import annotations

import time
from itertools import combinations, product

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.numbers import rounded
from claimwright.operators import ensembles as en
from claimwright.operators import models as mo
from claimwright.operators import rbf
from claimwright.operators import trees as tr
from claimwright.operators.boosting import Growth, Lane, TreeModel, fit_many
from claimwright.operators.clean import finite_target
from claimwright.operators.linear import fit_linear
from claimwright.operators.metrics import improvement_pct, regression_metrics
from claimwright.operators.neighbours import distance_weighted, nearest
from claimwright.operators.segments import SegmentDictionary, segment_multi, segment_single
from claimwright.operators.split import holdout
from claimwright.operators.unified import (
    UnifiedSegmentedModel,
    boosted_per_segment,
    boosted_segmentations,
)
from claimwright.plans.base import base, written_claims
from claimwright.plans.linear_models import shown_metrics
from claimwright.plans.registry import query
from claimwright.plans.sql import on_base
from claimwright.session import settle, shared_path, spread
from claimwright.sources.claims import CATEGORICAL, KEY, NUMERIC, TARGET
from claimwright.sources.tables import load_model, save_model

FEATURES = [*NUMERIC, "days_to_claim", "total_special", "total_general", "special_general_ratio",
            "severe_injury", "whiplash_flag", "psych_flag"]
#: Sizes of the published study; searches, stacks and single models grow as many trees.
TREES, TUNED_TREES, STACK_TREES, SEGMENT_TREES = 100, 200, 200, 150
#: Depth that stands for a forest without one. A tree then has at most 2**17 nodes, so the size of
#: a forest does not follow the rows; its trees are written where they grow.
FOREST_DEPTH = 16
#: Depth of the forests inside stacks and suites, which grow once for each fold as well.
SUITE_DEPTH = 10


def model_frame(spark, sf_dir) -> DataFrame:
    """One written frame that all fits of a query share."""
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    frame = base(spark, sf_dir).select(
        KEY, "y", "split", "fold", "inner_fold", *CATEGORICAL, *columns
    )
    return settle(spread(frame, KEY), "model-frame")


def halves(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    return frame.where("split = 'train'"), frame.where("split = 'test'")


def _rows(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return shown_metrics(result, "model")


def _single(spark, sf_dir, name, estimator) -> DataFrame:
    train, test = halves(model_frame(spark, sf_dir))
    return _rows([mo.test_metrics(mo.fit_on(train, FEATURES, estimator), test, name)])


@query("random_forest")
def random_forest(spark, sf_dir) -> DataFrame:
    return _single(spark, sf_dir, "random_forest", mo.random_forest(TREES, FOREST_DEPTH))


@query("gradient_boosting")
def gradient_boosting(spark, sf_dir) -> DataFrame:
    return _single(spark, sf_dir, "gradient_boosting", mo.gradient_boosting(TREES))


@query("xgboost_like")
def xgboost_like(spark, sf_dir) -> DataFrame:
    tuned = mo.boosted_trees(TREES, rate=0.1, depth=5, subsample=0.8)
    return _single(spark, sf_dir, "boosted_trees", tuned)


@query("preprocess_pipeline")
def preprocess_pipeline(spark, sf_dir) -> DataFrame:
    """Scaled numbers and indicator columns in one fitted chain, then least squares."""
    train, test = halves(model_frame(spark, sf_dir))
    stages = mo.preprocess_stages(FEATURES, CATEGORICAL)
    model = Pipeline(stages=[*stages, mo.ridge(1.0, *mo.target_deviation(train, "y"))]).fit(train)
    return _rows([mo.test_metrics(model, test, "preprocessed_ridge")])


@query("rbf_regression")
def rbf_regression(spark, sf_dir) -> DataFrame:
    """Support-vector regression over all features on the scale of their deviations."""
    train, test = halves(model_frame(spark, sf_dir))
    scale = train.agg(*[F.stddev_pop(c).alias(c) for c in FEATURES], F.stddev_pop("y").alias("y")).first()
    scaled = {c: F.col(c) / F.lit(scale[c] or 1.0) for c in FEATURES}
    model = rbf.fit_rbf(train.withColumns(scaled), FEATURES, cost=1.0, epsilon=0.1)
    return _rows([mo.test_metrics(model, test.withColumns(scaled), "rbf")])


GRID = {"rate": (0.05, 0.1), "depth": (3, 5), "min_child": (1.0, 3.0)}


def grid_search(train: DataFrame, features, grid: dict, trees: tuple[int, ...], fold: str = "inner_fold", folds: int = 5) -> list[dict]:
    """Mean R² over left-out folds of every combination, best first."""
    return searched_and_fitted(train, features, grid, trees, fold, folds, refit=False)[0]


def searched_and_fitted(train: DataFrame, features, grid: dict, trees: tuple[int, ...], fold: str = "inner_fold", folds: int = 5, refit: bool = True) -> tuple[list[dict], TreeModel | None]:
    """The rows of ``grid_search``, and the model of the best combination on all rows. All points
    and folds grow side by side, and so do the models on all rows: the best one grown afterwards
    would keep one task busy. Numbers of trees are prefixes of one fit."""
    points = [dict(zip(grid, c)) for c in product(*grid.values())]
    lanes = {
        f"{i}|{k}": Lane(mo.boosted_trees(max(trees), **c), k) for i, c in enumerate(points) for k in [*range(folds), *([None] if refit else [])]
    }
    fitted = fit_many(train, features, lanes, fold=fold, key=KEY, marks=trees)
    rows = [
        {**c, "trees": n, "cv_r2": sum(fitted[f"{i}|{k}"].left_out_r2[n] for k in range(folds)) / folds}
        for i, c in enumerate(points)
        for n in trees
    ]
    rows.sort(key=lambda r: -r["cv_r2"])
    best = points.index({c: rows[0][c] for c in grid})
    return rows, fitted[f"{best}|None"].first(rows[0]["trees"]) if refit else None


@query("grid_search_cv")
def grid_search_cv(spark, sf_dir) -> DataFrame:
    """Mean cross-validated R² of sixteen points, and for the best one the holdout
    metrics of its refit on all training rows."""
    train, test = halves(model_frame(spark, sf_dir))
    found, refit = searched_and_fitted(train, FEATURES, GRID, (TREES, TUNED_TREES))
    best = found[0]
    measured = mo.test_metrics(refit, test, "best").first()
    rows = [
        (float(r["rate"]), float(r["depth"]), float(r["trees"]), r["min_child"], r["cv_r2"], r is best, *((measured[m] if r is best else None) for m in ("rmse", "mae", "r2")))
        for r in found
    ]
    schema = "step_size double, max_depth double, n_trees double, min_child double, cv_r2 double, best boolean, test_rmse double, test_mae double, test_r2 double"
    return spark.createDataFrame(rows, schema).orderBy(F.col("cv_r2").desc())


def default_and_tuned(spark, sf_dir) -> DataFrame:
    """``model`` and test metrics of every prefix of the default and the tuned booster, which
    grow side by side."""
    train, test = halves(model_frame(spark, sf_dir))
    lanes = {
        "default": Lane(mo.boosted_trees(TREES)),
        "tuned": Lane(mo.boosted_trees(TUNED_TREES, rate=0.1, depth=5, subsample=0.8)),
    }
    fitted = fit_many(train, FEATURES, lanes, key=KEY)
    parts = [fitted[m].staged_metrics(test).withColumn("model", F.lit(m)) for m in lanes]
    return settle(parts[0].unionByName(parts[1]), "stages")


@query("learning_curves")
def learning_curves(spark, sf_dir) -> DataFrame:
    """Test metrics of the default and the tuned booster after every tree."""
    shown = [rounded(F.col(c), 6 if c == "r2" else 4).alias(c) for c in ("rmse", "mae", "r2")]
    return default_and_tuned(spark, sf_dir).select("model", "trees", "n", *shown).orderBy("model", "trees")


@query("default_vs_tuned")
def default_vs_tuned(spark, sf_dir) -> DataFrame:
    """Default and tuned booster side by side, with the gains of the tuned one and the number
    of trees after which each was best."""
    curves = default_and_tuned(spark, sf_dir)
    last = (F.col("model") == "default") & (F.col("trees") == TREES) | (F.col("model") == "tuned") & (F.col("trees") == TUNED_TREES)
    pair = curves.agg(
        *[
            F.max(F.when(last & (F.col("model") == m), F.col(c))).alias(f"{m}_{c}")
            for m in ("default", "tuned")
            for c in ("rmse", "mae", "r2")
        ],
        *[F.min_by(F.when(F.col("model") == m, F.col("trees")), F.when(F.col("model") == m, F.col("rmse"))).alias(f"{m}_best_trees") for m in ("default", "tuned")],
    )
    return pair.withColumns(
        {
            "r2_gain_pct": improvement_pct(F.col("tuned_r2"), F.col("default_r2")),
            "rmse_gain_pct": improvement_pct(F.col("tuned_rmse"), F.col("default_rmse"), True),
        }
    )


def base_trees(trees: int) -> dict[str, object]:
    return {
        "rf": mo.random_forest(trees, 10),
        "gb": mo.gradient_boosting(trees, 0.1, 5),
        "boosted": mo.boosted_trees(trees, rate=0.1, depth=5, min_child=3),
    }


@query("stacking_trees")
def stacking_trees(spark, sf_dir) -> DataFrame:
    """Ridge over out-of-fold predictions of a forest and two boosters."""
    train, test = halves(model_frame(spark, sf_dir))
    bases = base_trees(STACK_TREES)
    inside, outside, _ = en.tree_out_of_fold(train, test, FEATURES, bases, "inner_fold", key=KEY)
    names = [f"pred_{b}" for b in bases]
    meta = mo.fit_on(inside, names, mo.ridge(0.1, *mo.target_deviation(inside, "y")))
    return _rows([mo.test_metrics(meta, outside, "stacked")])


def meta_learners(n: int, deviation: float, trees: int) -> dict[str, object]:
    return {
        "linear": LinearRegression(labelCol="y", solver="normal"),
        "ridge": mo.ridge(0.1, n, deviation),
        "lasso": mo.elastic_net(0.01, 1.0, deviation),
        "elastic_net": mo.elastic_net(0.01, 0.5, deviation),
        # The objective of stochastic descent, by quasi-Newton steps until it converges.
        "sgd": mo.elastic_net(0.01, 0.5, deviation, rows=n, solver="l-bfgs"),
        "random_forest": mo.random_forest(trees, 5),
        "gradient_boosting": mo.gradient_boosting(trees, 0.05, 3),
        "boosted_trees": mo.boosted_trees(trees, rate=0.05, depth=3),
    }


@query("metalearner_sweep")
def metalearner_sweep(spark, sf_dir) -> DataFrame:
    """Ten meta-learners over one out-of-fold table, which is computed once."""
    train, test = halves(model_frame(spark, sf_dir))
    bases = base_trees(STACK_TREES)
    inside, outside, _ = en.tree_out_of_fold(train, test, FEATURES, bases, "inner_fold", key=KEY)
    names = [f"pred_{b}" for b in bases]
    n, deviation = mo.target_deviation(inside, "y")
    learners = meta_learners(n, deviation, TREES)
    grown = fit_many(inside, names, {name: Lane(g) for name, g in learners.items() if isinstance(g, Growth)}, key=KEY)
    fitted = {name: grown[name] if name in grown else mo.fit_on(inside, names, estimator) for name, estimator in learners.items()}
    parts = [mo.test_metrics(model, outside, name) for name, model in fitted.items()]
    parts.append(mo.test_metrics(rbf.fit_rbf(inside, names), outside, "rbf"))

    keep = [KEY, "y", *names]
    both = inside.select(*keep, F.lit(False).alias("new")).unionByName(
        outside.select(*keep, F.lit(True).alias("new"))
    )
    found = nearest(
        both.withColumn("everyone", F.lit("all")), KEY, names, 5, "everyone",
        asks=F.col("new"), answers=~F.col("new"), axes=names,
    )
    with_y = found.join(inside.select(F.col(KEY).alias("neighbour"), "y"), "neighbour")
    scored = distance_weighted(with_y, KEY).join(outside.select(KEY, "y"), KEY)
    parts.append(regression_metrics(scored).withColumn("model", F.lit("knn")))
    return _rows(parts).orderBy(F.col("r2").desc_nulls_last(), "model")


@query("feature_importance")
def feature_importance(spark, sf_dir) -> DataFrame:
    """Mean gain of the splits of a booster, largest first."""
    train, _ = halves(model_frame(spark, sf_dir))
    model = mo.fit_on(train, FEATURES, mo.boosted_trees(TREES, rate=0.1, depth=5))
    return spark.createDataFrame(
        mo.importances(model), "place int, feature string, importance double"
    )


@query("per_segment_boosted")
def per_segment_boosted(spark, sf_dir) -> DataFrame:
    """One booster per segment of the circumstances, all grown side by side."""
    train, test = halves(model_frame(spark, sf_dir).withColumn("segment", F.col("exceptional_circumstances")))
    model = boosted_per_segment(train, FEATURES, mo.boosted_trees(SEGMENT_TREES, 0.1, 5, subsample=0.8, column_share=0.8))
    scored = model.transform(test).where("prediction is not null")
    return shown_metrics(regression_metrics(scored, ["segment"]), "segment")


@query("segment_prediction_boosted")
def segment_prediction_boosted(spark, sf_dir) -> DataFrame:
    """Out-of-fold segment prediction and all numbers as features of one booster."""
    frame = model_frame(spark, sf_dir)
    train, test = halves(frame)
    base_learner = [en.LinearBase("segment", ["total_special", "total_general"], ["exceptional_circumstances"])]
    folded = train.withColumn("fold", F.col("inner_fold"))
    models = en.fit_bases(folded, base_learner, "fold")
    inside = settle(en.base_predictions(folded, models, True), "segment-train")
    outside = en.base_predictions(test, models, False)
    model = mo.fit_on(inside, [*FEATURES, "pred_segment"], mo.boosted_trees(TREES, rate=0.05, depth=3))
    return _rows([mo.test_metrics(model, outside, "segment_prediction")])


def boosted_search(frame: DataFrame, dictionaries: dict[str, SegmentDictionary], estimator, most_values: int | None) -> DataFrame:
    """Weighted test metrics of one booster per segment for every candidate segmentation. One
    of more than ``most_values`` values, or of a single segment, is left out."""
    kept = {
        name: dictionary
        for name, dictionary in dictionaries.items()
        if dictionary.sizes().count() >= 2 and (most_values is None or dictionary.table.count() <= most_values)
    }
    result = boosted_segmentations(frame, kept, FEATURES, estimator)
    if result is None:
        schema = "candidate string, rmse double, mae double, r2 double, n_total long"
        return frame.sparkSession.createDataFrame([], schema)
    shown = [rounded(F.col(c), 6 if c == "r2" else 4).alias(c) for c in ("rmse", "mae", "r2")]
    return result.select("candidate", *shown, "n_total").orderBy(F.col("r2").desc_nulls_last(), "candidate")


def single_boosted(frame: DataFrame) -> DataFrame:
    singles = {c: segment_single(frame, c) for c in CATEGORICAL}
    return boosted_search(frame, singles, mo.boosted_trees(TREES), most_values=20)


@query("segmentation_search_boosted")
def segmentation_search_boosted(spark, sf_dir) -> DataFrame:
    """Every text column as a segmentation with one booster per segment, best first."""
    return single_boosted(model_frame(spark, sf_dir))


@query("pairwise_search_boosted")
def pairwise_search_boosted(spark, sf_dir) -> DataFrame:
    """All pairs of the five best columns, with one booster per segment of each pair."""
    frame = model_frame(spark, sf_dir)
    best = [r["candidate"] for r in single_boosted(frame).limit(5).collect()]
    pairs = {f"{a} + {b}": segment_multi(frame, [a, b]) for a, b in combinations(best, 2)}
    return boosted_search(frame, pairs, mo.boosted_trees(TREES), most_values=None)


@query("stacked_segment_model")
def stacked_segment_model(spark, sf_dir) -> DataFrame:
    """Booster on wide meta-features (own and all segment predictions) and the numbers."""
    frame = model_frame(spark, sf_dir)
    train = frame.where("split = 'train'").withColumn("fold", F.col("inner_fold"))
    models = fit_linear(train, ["total_special", "total_general"], "y", ["exceptional_circumstances"], "fold")
    left_out = F.when(F.col("split") == "train", F.col("inner_fold"))
    names = en.fitted_groups(models, "exceptional_circumstances")
    wide = en.meta_features_wide(
        frame.withColumn("left_out", left_out), models, "exceptional_circumstances", names, "left_out"
    )
    meta = [f"{p}{s}" for p in ("pred_", "all_pred_") for s in names]
    meta += ["pred_mean", "all_pred_mean", "segment_prediction"]
    ready = settle(spread(wide.na.fill(0.0, meta), KEY), "stacked-segments")
    train, test = halves(ready)
    model = mo.fit_on(train, [*meta, *FEATURES], mo.boosted_trees(SEGMENT_TREES, rate=0.05, depth=4, subsample=0.9))
    return _rows([mo.test_metrics(model, test, "stacked_segments")])


@query("unified_segmented_model")
def unified_segmented_model(spark, sf_dir) -> DataFrame:
    """Fit on the raw training claims, score the raw test claims."""
    raw = written_claims(spark, sf_dir).withColumn("split", holdout(F.col(KEY)))
    fitted = UnifiedSegmentedModel().fit(raw.where("split = 'train'"))
    test = finite_target(raw.where("split = 'test'"), TARGET)
    return _rows([fitted.score(test).withColumn("model", F.lit("unified"))])


@query(
    "model_save_load",
    on_base("SELECT count(*) AS n, count(*) AS n_equal FROM base WHERE split = 'test'"),
)
def model_save_load(spark, sf_dir) -> DataFrame:
    """A loaded model must predict every test row exactly as the saved one."""
    train, test = halves(model_frame(spark, sf_dir))
    model = mo.fit_on(train, FEATURES, mo.boosted_trees(TREES, 0.1, 3))
    path = shared_path(spark, "saved-model")
    save_model(model, path)
    first = model.transform(test).select(KEY, *FEATURES, F.col("prediction").alias("saved"))
    both = load_model(path, TreeModel).transform(first)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("saved") == F.col("prediction")).alias("n_equal")
    )


@query("decision_paths")
def decision_paths(spark, sf_dir) -> DataFrame:
    """The tests a record passes in the first three trees of a booster, and the leaf it reaches."""
    train, test = halves(model_frame(spark, sf_dir))
    model = mo.fit_on(train, FEATURES, mo.boosted_trees(TREES, 0.1, 4))
    found = tr.decision_paths(model, test, KEY, FEATURES)
    return found.select(
        KEY, "tree", "leaf", rounded(F.col("value")).alias("value"), tr.predicate(F.col("path")).alias("path")
    )


def suite(train: DataFrame, trees: int, forest_depth: int) -> dict[str, object]:
    n, deviation = mo.target_deviation(train, "y")
    return {
        "Linear Regression": LinearRegression(labelCol="y", solver="normal"),
        "Ridge Regression": mo.ridge(1.0, n, deviation),
        "Lasso Regression": mo.elastic_net(0.001, 1.0, deviation),
        "Random Forest": mo.random_forest(trees, forest_depth),
        "Gradient Boosting": mo.gradient_boosting(trees),
        "XGBoost": mo.boosted_trees(trees),
        "Tuned XGBoost": mo.boosted_trees(2 * trees, rate=0.1, depth=5, subsample=0.8),
    }


def timed_suite(frame: DataFrame, raw: DataFrame | None, trees: int, forest_depth: int, folds: int = 5) -> list[dict]:
    """Fit, predict and measure every model with its wall time; the stack's out-of-fold
    table serves the vote as well."""
    train, test = halves(frame)
    results = []

    def timed(name, run):
        start = time.time()
        row = run().first().asDict()
        results.append({**row, "model": name, "seconds": time.time() - start})

    for name, estimator in suite(train, trees, forest_depth).items():
        timed(name, lambda: mo.test_metrics(mo.fit_on(train, FEATURES, estimator), test, name))

    bases = {
        "rf": mo.random_forest(trees, forest_depth),
        "gbm": mo.gradient_boosting(trees),
        "xgb": mo.boosted_trees(trees),
    }
    names = [f"pred_{b}" for b in bases]

    def vote():
        scored = test
        for name, model in fit_many(train, FEATURES, {n: Lane(g) for n, g in bases.items()}, key=KEY).items():
            scored = model.transform(scored, f"pred_{name}")
        return regression_metrics(scored.select("y", en.mean_vote(names).alias("prediction")))

    def stack():
        inside, outside, _ = en.tree_out_of_fold(train, test, FEATURES, bases, "inner_fold", folds, KEY)
        meta = mo.elastic_net(0.001, 0.5, mo.target_deviation(inside, "y")[1])
        return mo.test_metrics(mo.fit_on(inside, names, meta), outside, "stack")

    timed("Voting Ensemble", vote)
    timed("Stacking Ensemble", stack)
    if raw is not None:
        timed(
            "Unified Segmented Model",
            lambda: UnifiedSegmentedModel()
            .fit(raw.where("split = 'train'"))
            .score(finite_target(raw.where("split = 'test'"), TARGET)),
        )
    return results


@query("model_suite")
def model_suite(spark, sf_dir) -> DataFrame:
    """Ten models on one split with wall time, best R² first."""
    raw = written_claims(spark, sf_dir).withColumn("split", holdout(F.col(KEY)))
    rows = timed_suite(model_frame(spark, sf_dir), raw, TREES, SUITE_DEPTH)
    order = ["model", "n", "mse", "rmse", "mae", "r2", "seconds"]
    schema = "model string, n long, mse double, rmse double, mae double, r2 double, seconds double"
    table = spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)
    return table.orderBy(F.col("r2").desc_nulls_last())
