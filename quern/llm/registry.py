"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_baskets", "queries_edits", "queries_leakage", "queries_packing", "queries_repetition", "queries_vectors")

QUERIES = {k: f for m in MODULES for k, f in import_module(f"quern.llm.{m}").QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in import_module(f"quern.llm.{m}").ORACLE.items()}
