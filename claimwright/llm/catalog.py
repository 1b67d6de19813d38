"""All registered corpus queries. Importing the modules fills the registry."""

from __future__ import annotations

import importlib

from claimwright.llm.registry import ORACLES, QUERIES

for _module in ("language_model", "decontaminate", "language_id", "quality", "packing", "ngram_join", "suffix_dedup", "secrets", "html_text", "top_k", "hard_negatives", "lattice_dedup", "token_alignment"):
    importlib.import_module(f"claimwright.llm.{_module}")

__all__ = ["ORACLES", "QUERIES"]
