"""Small helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns, so sums added in another order compare equal."""
    return df.select(
        *[
            (F.round(F.col(f"`{name}`"), digits) + F.lit(0.0)).alias(name)
            if kind == "double"
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0::DOUBLE"
