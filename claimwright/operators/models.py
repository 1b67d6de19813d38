"""Single models: linear ones as pyspark.ml estimators, trees as histogram growths.

All tree models grow in ``boosting``: first-order boosting of squared error is second-order
boosting without leaf penalty, and a forest is trees on drawn rows that fit the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.operators.boosting import Growth, TreeModel
from claimwright.operators.metrics import regression_metrics
from claimwright.sources.claims import KEY

SEED = 42
#: Rows that are worth a task of a solver that passes over all rows at every step.
STEP_ROWS = 1 << 19


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output)


def target_deviation(df: DataFrame, target: str) -> tuple[int, float]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    return row["n"], row["s"]


def penalised(l1: float, l2: float, deviation: float, target: str = "y", rows: int | None = None, **params) -> LinearRegression:
    """Minimise ``||y-Xb||²/2n + l1·|b| + l2·b²/2`` on unscaled features.

    pyspark.ml scales the target by its deviation inside, which leaves an L1 weight as it
    is and divides an L2 weight by that deviation: the population's with the ``normal``
    solver, which needs one pass over the data whatever the number of iterations, and the
    sample's with ``l-bfgs``, for which ``rows`` must be given.
    """
    if params.get("solver") == "l-bfgs":
        deviation *= (rows / (rows - 1)) ** 0.5
    params = {"solver": "normal", "maxIter": 1000, "tol": 1e-12} | params
    weight = l1 + l2 * deviation
    return LinearRegression(
        labelCol=target,
        regParam=weight,
        elasticNetParam=l1 / weight if weight else 0.0,
        standardization=False,
        **params,
    )


def ridge(alpha: float, n: int, deviation: float, **params) -> LinearRegression:
    return penalised(0.0, alpha / n, deviation, **params)


def elastic_net(alpha: float, l1_ratio: float, deviation: float, **params) -> LinearRegression:
    return penalised(alpha * l1_ratio, alpha * (1 - l1_ratio), deviation, **params)


def random_forest(trees: int = 100, depth: int = 10) -> Growth:
    return Growth(trees, depth=depth, l2=0.0, forest=True, seed=SEED)


def gradient_boosting(trees: int = 100, rate: float = 0.1, depth: int = 3) -> Growth:
    return Growth(trees, rate, depth, l2=0.0, seed=SEED)


def boosted_trees(
    trees: int = 100,
    rate: float = 0.3,
    depth: int = 6,
    min_child: float = 1.0,
    subsample: float = 1.0,
    column_share: float = 1.0,
    min_gain: float = 0.0,
    l2: float = 1.0,
) -> Growth:
    return Growth(trees, rate, depth, min_child, l2, min_gain, subsample, column_share, seed=SEED)


def preprocess_stages(numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> list:
    """Numeric branch (scaled) and categorical branch (indicators; a value or NULL not seen
    in training gives zeros), assembled into one sparse vector."""
    indexed = [f"{c}_index" for c in categorical]
    encoded = [f"{c}_vector" for c in categorical]
    stages = [
        VectorAssembler(inputCols=list(numeric), outputCol="numeric_raw"),
        StandardScaler(inputCol="numeric_raw", outputCol="numeric_scaled", withMean=True),
    ]
    if categorical:
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
    return [*stages, VectorAssembler(inputCols=["numeric_scaled", *encoded], outputCol=output)]


def fit_on(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel | TreeModel:
    if isinstance(estimator, Growth):
        return estimator.fit(train, features, key=KEY if KEY in train.columns else None)
    if estimator.getSolver() == "l-bfgs":
        # Hundreds of steps, each a job that waits for all of its tasks.
        train = train.coalesce(max(1, -(-train.count() // STEP_ROWS)))
    return Pipeline(stages=[assembler(features), estimator]).fit(train)


def test_metrics(model: PipelineModel | TreeModel, test: DataFrame, name: str) -> DataFrame:
    scored = model.transform(test).select("y", "prediction")
    return regression_metrics(scored).withColumn("model", F.lit(name))


def importances(model: TreeModel, top: int = 10) -> list[tuple[int, str, float]]:
    """Largest importances first, as ``(rank, feature, importance)``."""
    order = sorted(zip(model.features, model.importances()), key=lambda p: (-p[1], p[0]))[:top]
    return [(i, f, float(v)) for i, (f, v) in enumerate(order, start=1)]
