"""Set operators. All match columns by position, as the language does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), parts)


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """``TOP n`` under a total order: each task keeps ``n`` rows, then one merge."""
    return df.orderBy(*order).limit(n)
