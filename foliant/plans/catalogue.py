"""Every registered query of the engine, by name, with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import document_queries, editing_queries, extension_queries, layout_queries, proofreading_queries, rebuild_queries, relational_queries, sharing_queries, text_queries

#: Modules with QUERIES (name to function of session and folder) and ORACLES (name to SQL).
MODULES: list[ModuleType] = [relational_queries, sharing_queries, text_queries, document_queries, layout_queries, editing_queries, rebuild_queries, proofreading_queries, sharing_queries, extension_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(queries().values()))(spark, sf_dir)
