"""Registered queries and their SQL, collected from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tamiz.plans


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(tamiz.plans.__path__) if m.name != "catalog")
    return [m for n in names if hasattr(m := importlib.import_module(f"tamiz.plans.{n}"), "QUERIES")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.SQL.items()}
