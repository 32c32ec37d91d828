"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import features, measure, prepare, searches

MODULES = [prepare, features, measure, searches]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return prepare.p1_found(spark, d)
