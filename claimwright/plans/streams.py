"""The streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.numbers import rounded
from claimwright.operators.ensembles import clip_nonnegative
from claimwright.operators.linear import fit_linear, linear_value
from claimwright.plans.base import base
from claimwright.plans.linear_models import TWO
from claimwright.plans.registry import query
from claimwright.plans.sql import on_base
from claimwright.session import settle, shared_path
from claimwright.sources.claims import KEY
from claimwright.streaming.score import score_stream


@query(
    "score_stream",
    on_base(
        """SELECT claim_id, round(greatest(ay + b1 * (total_special - a1) + b2 * (total_general - a2), 0), 4) AS prediction
        FROM base, (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2
          FROM (SELECT avg(total_special) AS a1, avg(total_general) AS a2, avg(y) AS ay, var_pop(total_special) AS v1,
            var_pop(total_general) AS v2, covar_pop(total_special, total_general) AS v12,
            covar_pop(total_special, y) AS c1, covar_pop(total_general, y) AS c2 FROM base WHERE split = 'train'))"""
    ),
)
def stream_scores(spark, sf_dir) -> DataFrame:
    """A fitted model applied to claim files as they arrive; the result is what the sink holds."""
    frame = base(spark, sf_dir, *TWO).select(KEY, "y", "split", *TWO)
    model = fit_linear(settle(frame.where("split = 'train'"), "stream-train"), TWO, "y").only()
    source, sink = shared_path(spark, "stream-in"), shared_path(spark, "stream-out")
    frame.select(KEY, *TWO).hint("rebalance", KEY).write.parquet(source)

    def score(df: DataFrame) -> DataFrame:
        slopes = F.array(*[F.lit(b) for b in model["slopes"]])
        value = linear_value(F.lit(model["intercept"]), slopes, TWO)
        return df.select(KEY, rounded(clip_nonnegative(value)).alias("prediction"))

    schema = spark.read.parquet(source).schema
    running = score_stream(
        spark, source, schema, score, sink, shared_path(spark, "stream-state"), files_per_batch=2
    )
    running.awaitTermination()
    return spark.read.parquet(sink)
