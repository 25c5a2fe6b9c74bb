"""Every registered query with the SQL it is compared with.

``QUERIES[name]`` takes ``(spark, sf_dir)``; ``ORACLES[name]`` is the SQL, absent
for jobs whose result SQL cannot state (learned models, file fingerprints).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every double column, so both engines state the same digits."""
    return df.select(
        *[
            F.round(f"`{f.name}`", decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rounded(*columns: str, decimals: int = 6) -> str:
    return ", ".join(f"round({c}, {decimals}) AS {c}" for c in columns)


def load_all() -> None:
    from checks import panel_queries, scoring_queries, serving_queries  # noqa: F401, I001
    from checks import fitting_queries, learning  # noqa: F401
