"""Readers and writers of claims files, metric tables, run logs and models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwright.operators.boosting import TreeModel
from claimwright.sources.claims import CATEGORICAL, DATES, KEY, NUMERIC, TARGET

CLAIMS_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL]
    + [T.StructField(c, T.DateType()) for c in DATES]
    + [T.StructField(c, T.DoubleType()) for c in [*NUMERIC, TARGET]]
)


def scan_claims(
    spark: SparkSession, path: str, schema: T.StructType | None = CLAIMS_SCHEMA
) -> DataFrame:
    """Claims from Parquet, or from CSV with a header; ``schema=None`` infers (exploration)."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)
    return spark.read.parquet(path)


def sink_metrics(metrics: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a metric table. Adaptive execution joins small parts to one file; a table of very
    many segments stays in several."""
    writer = metrics.hint("rebalance").write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def append_run(metrics: DataFrame, path: str, run_id: str, key: str = "model") -> None:
    """Append ``(run_id, run_ts, model, metric, value)`` rows to the log table at ``path``."""
    names = [c for c in metrics.columns if c != key]
    rows = metrics.select(
        F.col(key).alias("model"), *[F.col(c).cast("double").alias(c) for c in names]
    ).unpivot("model", names, "metric", "value")
    rows.select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("run_ts"), "model", "metric", "value"
    ).write.mode("append").parquet(path)


def save_model(model: PipelineModel | TreeModel, path: str) -> None:
    if isinstance(model, TreeModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: type = PipelineModel) -> PipelineModel | TreeModel:
    model = kind.load(SparkSession.active(), path) if kind is TreeModel else kind.load(path)
    if not isinstance(model, kind):
        raise TypeError(f"{path} holds no {kind.__name__}")
    return model


def metric_rows(spark: SparkSession, rows: list[Mapping]) -> DataFrame:
    """A small table of fitted results."""
    return spark.createDataFrame([dict(r) for r in rows])
