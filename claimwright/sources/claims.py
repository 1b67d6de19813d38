"""The claims table: one row per order of the star schema.

Nulls, NaN and infinity are put in by key arithmetic because the raw tables hold none.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "claim_id"
TARGET = "settlement_value"
SPECIAL = ["special_care", "special_earnings", "special_medical"]
GENERAL = ["general_rest", "general_pain"]
NUMERIC = SPECIAL + GENERAL + ["driver_age", "vehicle_age"]
CATEGORICAL = [
    "exceptional_circumstances",
    "accident_type",
    "whiplash",
    "minor_psychological_injury",
    "injury_description",
    "vehicle_type",
]
DATES = ["accident_date", "claim_date"]
COLUMNS = [KEY, *CATEGORICAL, *DATES, *NUMERIC, TARGET]

# Weights of the damage heads and of the target.
HEADS = {
    "special_care": ("l_returnflag", "A", 10),
    "special_earnings": ("l_returnflag", "N", 20),
    "special_medical": ("l_returnflag", "R", 30),
    "general_rest": ("l_linestatus", "F", 5),
    "general_pain": ("l_linestatus", "O", 15),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [
        F.sum(F.when(F.col(flag) == value, F.col("l_quantity") * weight)).alias(name)
        for name, (flag, value, weight) in HEADS.items()
    ]
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_shipdate").cast("date").alias("claim_date"),
            F.min("l_partkey").alias("part_key"),
            *heads,
        )
    )


def claims(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Claims with the given columns (all by default).

    The customer and part joins are left out when nothing asks for their columns:
    Catalyst cannot drop an outer join whose right side it does not know to be unique.
    """
    wanted = list(columns) if columns is not None else COLUMNS
    k = F.col("o_orderkey")
    frame = table(spark, sf_dir, "orders").join(
        _line_totals(spark, sf_dir), k == F.col("l_orderkey"), "left"
    )
    if "vehicle_type" in wanted:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        frame = frame.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    if "vehicle_age" in wanted:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
        frame = frame.join(part, F.col("part_key") == F.col("p_partkey"), "left")

    special = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in SPECIAL)
    general = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in GENERAL)
    settlement = (
        F.lit(0.5) * special
        + F.lit(0.8) * general
        + F.when(k % 23 == 0, 900.0).otherwise(0.0)
        + F.when(F.col("o_orderpriority").startswith("1"), 400.0).otherwise(0.0)
        + (F.col("o_custkey") % 100)
    )
    null = F.lit(None)
    expressions = {
        KEY: k,
        "exceptional_circumstances": F.when(k % 37 == 0, null)
        .when(k % 23 == 0, "Yes")
        .otherwise("No"),
        "accident_type": F.when(
            k % 251 == 0, F.concat(F.lit("Rare-"), (k % 7).cast("string"))
        ).otherwise(F.expr("substring(o_orderpriority, 3)")),
        "accident_date": F.when(k % 97 == 0, null).otherwise(F.col("o_orderdate").cast("date")),
        "claim_date": F.col("claim_date"),
        "driver_age": F.when(k % 53 == 0, null).otherwise(
            (18 + F.col("o_custkey") % 60).cast("double")
        ),
        "vehicle_age": F.col("p_size").cast("double") if "vehicle_age" in wanted else null,
        "whiplash": F.when(k % 3 == 0, "Yes").otherwise("No"),
        "minor_psychological_injury": F.when(k % 5 == 0, "Yes").otherwise("No"),
        "injury_description": F.when(k % 11 == 0, "Severe fracture")
        .when(k % 13 == 0, "MAJOR burn")
        .when(k % 41 == 0, null)
        .otherwise("Soft tissue"),
        "vehicle_type": F.col("c_mktsegment") if "vehicle_type" in wanted else null,
        TARGET: F.when(k % 101 == 0, null)
        .when(k % 499 == 0, float("nan"))
        .when(k % 503 == 0, float("inf"))
        .otherwise(settlement),
    }
    for head in HEADS:
        expressions[head] = F.col(head)
    return frame.select(*[expressions[c].alias(c) for c in wanted])
