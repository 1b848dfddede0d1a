"""Shuffle helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by key into the session's full number of partitions.

    Rows that are small but costly to work on would otherwise be coalesced into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def held(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns that are worked out once per row.

    A plain projection may be folded into the one above it. An array that a lambda looks into is
    then built again for every element looked at; passing it through a generator prevents that.
    """
    inner = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return df.selectExpr("*", f"inline(array(struct({inner})))")
