"""Collects the query modules of the core library."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("hot_keys", "scalars", "relational", "curves", "pipeline")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        found = getattr(import_module(f"docketlens.plans.{module}"), name)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query names defined twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
