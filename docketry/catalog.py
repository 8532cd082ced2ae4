"""Registry of the engine's queries: every query module contributes QUERIES and ORACLES."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("docketry.plans.reconcile", "docketry.plans.scalars", "docketry.plans.cases", "docketry.plans.governance", "docketry.plans.documents", "docketry.plans.commits", "docketry.plans.grids", "docketry.plans.pages", "docketry.plans.rulings")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= import_module(name).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(name).ORACLES
    return out
