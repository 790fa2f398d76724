"""Every query by name, and the SQL that each must equal."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import ORACLES, QUERIES

for _name in ("text_queries", "retrieval_queries", "lineage_queries", "evaluation_queries", "star_queries", "more_queries", "further_queries", "need_queries", "write_queries", "diagnostic_queries", "search_queries"):
    importlib.import_module(f"tidemark.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
