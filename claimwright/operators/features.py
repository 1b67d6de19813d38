"""Claim features as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.numbers import guarded
from claimwright.sources.claims import GENERAL, SPECIAL

# Words that mark a severe injury.
SEVERE_WORDS = ["severe", "major", "critical"]


def days_to_claim(start: Column, end: Column) -> Column:
    """Whole days from accident to claim; negative when the claim is dated earlier."""
    return F.datediff(end, start)


def claim_delay(start_text: Column, end_text: Column, form: str = "yyyy-MM-dd") -> Column:
    """Delay from date texts; a text that is no date, or no text at all, gives 0."""
    start = F.try_to_timestamp(start_text, F.lit(form))
    end = F.try_to_timestamp(end_text, F.lit(form))
    return F.coalesce(F.datediff(end.cast("date"), start.cast("date")), F.lit(0))


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def row_total(columns: Sequence[str]) -> Column:
    """Sum over columns with NULL as 0. The list is fixed when a model is fitted, so a
    derived column that shares the prefix never enters its own total."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), start=F.lit(0.0))


def severe_flag(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(SEVERE_WORDS)), F.lit(False)).cast("int")


def yes_flag(answer: Column) -> Column:
    return answer.eqNullSafe("Yes").cast("int")


def injury_column(df: DataFrame) -> str | None:
    """First text column named after an injury."""
    for name, kind in df.dtypes:
        if kind == "string" and ("Injury" in name or "injury" in name):
            return name
    return None


# What each derived feature is computed from; all others are columns of the claims.
NEEDS = {
    "days_to_claim": ["accident_date", "claim_date"],
    "total_special": SPECIAL,
    "total_general": GENERAL,
    "severe_injury": ["injury_description"],
    "whiplash_flag": ["whiplash"],
    "psych_flag": ["minor_psychological_injury"],
    "total_damages": ["total_special", "total_general"],
    "log_special": ["total_special"],
    "log_general": ["total_general"],
    "log_damages": ["total_damages"],
    "special_general_ratio": ["total_special", "total_general"],
    "age_damage_ratio": ["driver_age", "total_special"],
    "severe_special": ["severe_injury", "total_special"],
    "psych_special": ["psych_flag", "total_special"],
    "vehicle_age_special": ["vehicle_age", "total_special"],
    "severe_total": ["severe_injury", "total_damages"],
    "psych_total": ["psych_flag", "total_damages"],
    "special_squared": ["total_special"],
    "general_squared": ["total_general"],
}


def sources(columns: Iterable[str]) -> list[str]:
    """The claims columns that these columns, derived or not, come from."""
    found: list[str] = []
    for column in columns:
        parts = sources(NEEDS[column]) if column in NEEDS else [column]
        found += [p for p in parts if p not in found]
    return found


def engineered(df: DataFrame, injury: str = "injury_description") -> DataFrame:
    """All derived features whose columns are there. Every one is an expression in one
    projection pair, so the whole set stays inside a single code-generated stage."""
    special, general = F.col("total_special"), F.col("total_general")
    there = set(df.columns)

    def possible(columns: dict[str, Column]) -> dict[str, Column]:
        return {c: e for c, e in columns.items() if there.issuperset(injury if s == "injury_description" else s for s in sources([c]))}

    totals = df.withColumns(possible(
        {
            "days_to_claim": days_to_claim(F.col("accident_date"), F.col("claim_date")),
            "total_special": row_total(SPECIAL),
            "total_general": row_total(GENERAL),
            "severe_injury": severe_flag(F.col(injury)),
            "whiplash_flag": yes_flag(F.col("whiplash")),
            "psych_flag": yes_flag(F.col("minor_psychological_injury")),
        }
    ))
    total = special + general
    return totals.withColumns(possible(
        {
            "total_damages": total,
            "log_special": F.log1p(special),
            "log_general": F.log1p(general),
            "log_damages": F.log1p(total),
            "special_general_ratio": guarded(special, general),
            "age_damage_ratio": guarded(F.col("driver_age"), special),
            "severe_special": F.col("severe_injury") * special,
            "psych_special": F.col("psych_flag") * special,
            "vehicle_age_special": F.col("vehicle_age") * special / F.lit(1000.0),
            "severe_total": F.col("severe_injury") * total,
            "psych_total": F.col("psych_flag") * total,
            "special_squared": special * special,
            "general_squared": general * general,
        }
    ))
