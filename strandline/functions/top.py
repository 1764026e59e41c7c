"""Ordered limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def first(df: DataFrame, limit: int | None, *order: str | Column) -> DataFrame:
    """The first rows in the order; all rows, in any order, where the limit is None."""
    return df if limit is None else df.orderBy(*order).limit(limit)
