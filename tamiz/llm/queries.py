"""Queries of the training-data operators, by problem."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tamiz.llm


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(tamiz.llm.__path__) if m.name[0] == "p" and m.name[1:].isdigit())
    return [importlib.import_module(f"tamiz.llm.{n}") for n in names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.SQL.items()}
