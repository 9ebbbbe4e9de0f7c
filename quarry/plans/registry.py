"""Collects every registered query and its DuckDB oracle."""
from __future__ import annotations

import importlib

FAMILIES = ["q_events", "q_clean", "q_tables", "q_metrics", "q_sampling", "q_text", "q_neighbors", "q_models", "q_topics", "q_sources"]


def all_queries():
    q, sql = {}, {}
    for fam in FAMILIES:
        mod = importlib.import_module(f"quarry.plans.{fam}")
        q.update(mod.Q)
        sql.update(mod.SQL)
    return q, sql
