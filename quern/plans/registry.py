"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("itemsets", "similarity", "skew", "vectors", "recsys", "graph", "streaming", "sources")


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"quern.plans.{m}").QUERIES.items()}


def core_oracle() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"quern.plans.{m}").ORACLE.items()}
