"""First-row-wins duplicate removal and duplicate counts.

A popular key collapses to one row per map task in the partial aggregation, and rows are kept
by joining on their unique order column, so no key, however frequent, gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_orders(df: DataFrame, key: str, order: str) -> DataFrame:
    """The smallest order value of each key (null keys are equal to each other)."""
    return df.groupBy(key).agg(F.min(order).alias(order)).select(order)


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first row of each key; ``order`` must be unique."""
    return df.join(first_orders(df, key, order), order, "left_semi")


def surplus_rows(*keys: Column) -> list[Column]:
    """Aggregates counting the rows beyond the first of each key; nulls are one key."""
    columns = []
    for key in keys:
        null_group = F.max(key.isNull().cast("int"))
        distinct = F.count_distinct(key) + F.coalesce(null_group, F.lit(0))
        columns.append((F.count(F.lit(1)) - distinct).cast("long"))
    return columns
