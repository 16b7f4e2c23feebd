"""Every registered query of the engine and its DuckDB equivalent, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelframe.plans import derivation, details, formats, graphs, inform, media, reports, runs, sequences, streams, structures, texts, tracks

MODULES = [formats, derivation, streams, texts, sequences, reports, media, tracks, structures, graphs, runs, inform, details]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
