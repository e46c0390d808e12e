"""Queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glotta.plans import oracles, report_oracles
from glotta.plans import queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | report_oracles.oracle_sql()
