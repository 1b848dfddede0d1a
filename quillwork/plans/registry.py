"""Where a query meets its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``, with DuckDB SQL giving the same table."""

    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = re.sub(r"\n\s*\n", "\n", sql.strip())
        return fn

    return wrap
