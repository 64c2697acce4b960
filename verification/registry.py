"""Registry of verification queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so that both engines' last bits agree (``+ 0.0`` drops -0.0)."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round({expr}, {digits}) + 0e0 AS {name}"
