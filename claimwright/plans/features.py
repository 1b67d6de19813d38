"""Scalar feature engineering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.functions.numbers import guarded, rounded
from claimwright.operators import features as fe
from claimwright.plans.base import base
from claimwright.plans.registry import query
from claimwright.plans.sql import on_base, on_claims
from claimwright.sources.claims import GENERAL, KEY, SPECIAL, claims

_SPECIAL = "coalesce(special_care, 0) + coalesce(special_earnings, 0) + coalesce(special_medical, 0)"
_GENERAL = "coalesce(general_rest, 0) + coalesce(general_pain, 0)"
_TOTALS = f"t AS (SELECT *, {_SPECIAL} AS s, {_GENERAL} AS g FROM claims)"


def _totals(spark, sf_dir, *extra: str) -> DataFrame:
    """Raw claims with both row totals ``s`` and ``g``; nothing is imputed here."""
    frame = claims(spark, sf_dir, [KEY, *SPECIAL, *GENERAL, *extra])
    return frame.withColumns({"s": fe.row_total(SPECIAL), "g": fe.row_total(GENERAL)})


@query(
    "days_to_claim",
    on_claims("SELECT claim_id, CAST(date_diff('day', accident_date, claim_date) AS INTEGER) AS days_to_claim FROM claims"),
)
def days_to_claim(spark, sf_dir) -> DataFrame:
    frame = claims(spark, sf_dir, [KEY, "accident_date", "claim_date"])
    days = fe.days_to_claim(F.col("accident_date"), F.col("claim_date"))
    return frame.select(KEY, days.alias("days_to_claim"))


@query(
    "claim_delay_coerced",
    on_claims(
        """SELECT claim_id, CAST(coalesce(date_diff('day', TRY_CAST(a AS DATE), claim_date), 0) AS INTEGER) AS claim_delay_days
        FROM (SELECT *, CASE WHEN accident_type LIKE 'Rare%' THEN 'not recorded'
          ELSE CAST(accident_date AS VARCHAR) END AS a FROM claims)"""
    ),
)
def claim_delay_coerced(spark, sf_dir) -> DataFrame:
    """Dates as text; rare accident types carry a text that is no date."""
    frame = claims(spark, sf_dir, [KEY, "accident_type", "accident_date", "claim_date"])
    accident = F.when(F.col("accident_type").startswith("Rare"), "not recorded").otherwise(
        F.col("accident_date").cast("string")
    )
    delay = fe.claim_delay(accident, F.col("claim_date").cast("string"))
    return frame.select(KEY, delay.alias("claim_delay_days"))


@query(
    "prefix_totals",
    on_claims("SELECT claim_id, s AS total_special, g AS total_general FROM t", _TOTALS),
)
def prefix_totals(spark, sf_dir) -> DataFrame:
    frame = claims(spark, sf_dir, [KEY, *SPECIAL, *GENERAL])
    return frame.select(
        KEY,
        fe.row_total(fe.prefixed(frame, "special_")).alias("total_special"),
        fe.row_total(fe.prefixed(frame, "general_")).alias("total_general"),
    )


@query(
    "damage_ratio",
    on_claims(
        "SELECT claim_id, s / CASE WHEN g = 0 THEN 1 ELSE g END AS special_general_ratio FROM t",
        _TOTALS,
    ),
)
def damage_ratio(spark, sf_dir) -> DataFrame:
    ratio = guarded(F.col("s"), F.col("g"))
    return _totals(spark, sf_dir).select(KEY, ratio.alias("special_general_ratio"))


@query(
    "log_totals",
    on_claims(
        """SELECT claim_id, round(ln(1 + s), 6) AS log_special, round(ln(1 + g), 6) AS log_general,
        round(ln(1 + s + g), 6) AS log_damages FROM t""",
        _TOTALS,
    ),
)
def log_totals(spark, sf_dir) -> DataFrame:
    logs = {"log_special": F.col("s"), "log_general": F.col("g"), "log_damages": F.col("s") + F.col("g")}
    return _totals(spark, sf_dir).select(
        KEY, *[rounded(F.log1p(c), 6).alias(n) for n, c in logs.items()]
    )


@query("total_damages", on_claims("SELECT claim_id, s + g AS total_damages FROM t", _TOTALS))
def total_damages(spark, sf_dir) -> DataFrame:
    return _totals(spark, sf_dir).select(KEY, (F.col("s") + F.col("g")).alias("total_damages"))


@query(
    "age_damage_ratio",
    on_claims(
        "SELECT claim_id, driver_age / CASE WHEN s = 0 THEN 1 ELSE s END AS age_damage_ratio FROM t",
        _TOTALS,
    ),
)
def age_damage_ratio(spark, sf_dir) -> DataFrame:
    ratio = guarded(F.col("driver_age"), F.col("s"))
    return _totals(spark, sf_dir, "driver_age").select(KEY, ratio.alias("age_damage_ratio"))


@query(
    "severe_injury_flag",
    on_claims(
        """SELECT claim_id, CASE WHEN regexp_matches(lower(injury_description), 'severe|major|critical')
        THEN 1 ELSE 0 END AS severe_injury FROM claims"""
    ),
)
def severe_injury_flag(spark, sf_dir) -> DataFrame:
    frame = claims(spark, sf_dir, [KEY, "injury_description"])
    return frame.select(KEY, fe.severe_flag(F.col(fe.injury_column(frame))).alias("severe_injury"))


@query(
    "yes_no_flags",
    on_claims(
        """SELECT claim_id, CASE WHEN whiplash = 'Yes' THEN 1 ELSE 0 END AS whiplash_flag,
        CASE WHEN minor_psychological_injury = 'Yes' THEN 1 ELSE 0 END AS psych_flag,
        CASE WHEN exceptional_circumstances = 'Yes' THEN 1 ELSE 0 END AS exceptional_flag FROM claims"""
    ),
)
def yes_no_flags(spark, sf_dir) -> DataFrame:
    frame = claims(
        spark, sf_dir, [KEY, "whiplash", "minor_psychological_injury", "exceptional_circumstances"]
    )
    return frame.select(
        KEY,
        fe.yes_flag(F.col("whiplash")).alias("whiplash_flag"),
        fe.yes_flag(F.col("minor_psychological_injury")).alias("psych_flag"),
        fe.yes_flag(F.col("exceptional_circumstances")).alias("exceptional_flag"),
    )


@query(
    "interactions",
    on_base(
        """SELECT claim_id, severe_injury * total_special AS severe_special, psych_flag * total_special AS psych_special,
        round(vehicle_age * total_special / 1000, 6) AS vehicle_age_special,
        severe_injury * total_damages AS severe_total, psych_flag * total_damages AS psych_total FROM base"""
    ),
)
def interactions(spark, sf_dir) -> DataFrame:
    """Both published variants: with the special total, and with the total of all damages."""
    return base(spark, sf_dir, "severe_special", "psych_special", "vehicle_age_special", "severe_total", "psych_total").select(
        KEY,
        "severe_special",
        "psych_special",
        rounded(F.col("vehicle_age_special"), 6).alias("vehicle_age_special"),
        "severe_total",
        "psych_total",
    )


@query(
    "squared_totals",
    on_claims("SELECT claim_id, s * s AS special_squared, g * g AS general_squared FROM t", _TOTALS),
)
def squared_totals(spark, sf_dir) -> DataFrame:
    s, g = F.col("s"), F.col("g")
    return _totals(spark, sf_dir).select(
        KEY, (s * s).alias("special_squared"), (g * g).alias("general_squared")
    )
