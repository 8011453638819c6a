"""Registered queries: a Spark job over the tables of one folder, and its SQL twin.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLES[name]`` is the
same result as ANSI SQL, absent where SQL cannot express the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "ingest", "selection", "render", "notes", "images", "detection", "vectors", "sequences", "experiments", "whole", "sweeps", "stores",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def stable(value: Column, digits: int = 6) -> Column:
    """Round for comparison between engines.

    The offset keeps exact halves away from the rounding boundary, which the two
    engines treat differently, and the added zero removes a negative zero.
    """
    return F.round(value + F.lit(1e-10), digits) + F.lit(0.0)


def rounded(df: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Round every double outside ``keys``."""
    kinds = dict(df.dtypes)
    return df.select(*[
        stable(F.col(c), digits).alias(c) if kinds[c] == "double" and c not in keys else F.col(c)
        for c in df.columns
    ])


def load() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
