"""Views, modules and imports: parametrised rowsets bound by name."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession


class RowsetRegistry:
    """``VIEW``, ``Module.Function(...)`` and ``IMPORT ... AS`` over plain Python functions."""

    def __init__(self) -> None:
        self._entries: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str):
        def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self._entries[name] = fn
            return fn

        return add

    def view(self, name: str, spark: SparkSession, **params) -> DataFrame:
        """``VIEW name PARAMS(...)``: scalar parameters only."""
        return self._entries[name](spark, **params)

    def call(self, name: str, **params) -> DataFrame:
        """``name(Input = Rowset, Mode = "x")``: rowset and scalar parameters."""
        return self._entries[name](**params)

    def import_as(self, name: str, alias: str, spark: SparkSession, **params) -> DataFrame:
        """``IMPORT name AS alias PARAMS ...``: the result is also a temporary view."""
        result = self.view(name, spark, **params)
        result.createOrReplaceTempView(alias)
        return result


def sql_view(text: str, **tables: DataFrame):
    """A view given as SQL with named parameters and the rowsets it reads."""

    def build(spark: SparkSession, **params) -> DataFrame:
        return spark.sql(text, args=params, **tables)

    return build
