"""Tables read out of tree models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.operators.boosting import TreeModel
from claimwright.session import settle


def node_table(model: TreeModel, spark: SparkSession, trees: int | None = None) -> DataFrame:
    """Nodes of the first trees of a model; as many rows as these have nodes."""
    return spark.createDataFrame(model.nodes(trees), TreeModel.NODES)


def leaf_paths(nodes: DataFrame, features: Sequence[str], depth: int) -> DataFrame:
    """``(tree, leaf, value, path)``: the tests on the way to every leaf, root first."""
    names = F.array(*[F.lit(c) for c in features])
    tests = F.array(
        F.struct(F.col("left").alias("child"), F.lit("<=").alias("sign")),
        F.struct(F.col("right").alias("child"), F.lit(">").alias("sign")),
    )
    steps = settle(
        nodes.where("left >= 0")
        .select("tree", "node", names[F.col("feature")].alias("name"), "threshold", F.explode(tests).alias("t"))
        .select(
            "tree",
            F.col("t.child").alias("child"),
            F.col("node").alias("parent"),
            F.struct(
                F.col("name").alias("feature"), F.col("t.sign").alias("sign"), F.col("threshold").alias("threshold")
            ).alias("test"),
        ),
        "tree-steps",
    )
    root = F.array().cast("array<struct<feature:string,sign:string,threshold:double>>")
    reached = nodes.where("node = segment").select("tree", F.col("node").alias("at"), root.alias("path"))
    every = reached
    for _ in range(depth):
        reached = (
            reached.join(steps, (reached["tree"] == steps["tree"]) & (reached["at"] == steps["parent"]))
            .select(reached["tree"], F.col("child").alias("at"), F.concat("path", F.array("test")).alias("path"))
        )
        every = every.union(reached)
    leaves = nodes.where("left < 0").select("tree", F.col("node").alias("leaf"), "value")
    return leaves.join(
        every.withColumnsRenamed({"tree": "path_tree"}),
        (F.col("tree") == F.col("path_tree")) & (F.col("leaf") == F.col("at")),
    ).select("tree", "leaf", "value", "path")


def decision_paths(model: TreeModel, df: DataFrame, key: str, features: Sequence[str], trees: int = 3) -> DataFrame:
    """Path and leaf of every record in the first trees: ``(key, tree, leaf, value, path)``."""
    nodes = node_table(model, df.sparkSession, trees)
    paths = settle(leaf_paths(nodes, features, model.growth.depth), "leaf-paths")
    found = df.select(key, F.posexplode(model.path_leaves(trees)).alias("tree", "leaf_number"))
    return found.join(
        paths, (found["tree"] == paths["tree"]) & (found["leaf_number"] == paths["leaf"])
    ).select(key, paths["tree"], paths["leaf"], "value", "path")


def predicate(path) -> F.Column:
    """A path as text."""
    return F.concat_ws(
        " and ",
        F.transform(
            path,
            lambda t: F.concat_ws(" ", t["feature"], t["sign"], F.round(t["threshold"], 4).cast("string")),
        ),
    )
