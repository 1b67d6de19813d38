"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

import importlib

from claimwright.plans.registry import ORACLES, QUERIES

for _module in (
    "cleaning", "features", "segments", "linear_models", "evaluation", "explain", "tree_models", "explain_models", "streams",
):
    importlib.import_module(f"claimwright.plans.{_module}")


def flagship(spark, sf_dir):
    return QUERIES["segment_metrics"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
