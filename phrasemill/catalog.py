"""All registered queries of the text-mining engine and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS = ("bibliography", "numbers", "logs", "generation", "streams")


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for name in PLANS:
        found |= importlib.import_module(f"phrasemill.plans.{name}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: o for k, (_, o) in _all().items() if o}
