"""All queries over the given tables, gathered from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tidemark.plans as plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            yield importlib.import_module(f"{plans.__name__}.{info.name}")


def queries() -> dict[str, Query]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
