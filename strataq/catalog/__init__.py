"""Every registered query and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package; each has QUERIES, a dict from name to (function, oracle or None).
MODULES = ("findings", "measures", "pages", "graphs", "stateful", "code", "more", "texts")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all()["language_health"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
