"""All queries of the engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import kernels, live, rescue, stream  # noqa: F401  (each adds its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(kernels.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(kernels.SQL)
