"""Queries over the driver's tables and their SQL twins, by operator id.

A query applies one operator to views of the driver's tables (plans/fixtures.py). The views are written in
SQL that Spark and DuckDB read alike, so the twin shares the input and nothing else.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytolake.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def operator(name: str, *views: str, sql: str | None = None, also: tuple[str, ...] = ()):
    """Registers a function of the views' DataFrames under name; sql may use the views and those in also."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*[fixtures.view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLES[name] = fixtures.with_views(sql, *views, *also)
        return fn

    return register


for _name in ("molecules", "reads", "barcodes", "expression", "sampling", "clones", "alignments", "tables"):
    try:
        importlib.import_module(f"cytolake.plans.{_name}_queries")
    except ModuleNotFoundError as missing:
        if missing.name != f"cytolake.plans.{_name}_queries":
            raise
