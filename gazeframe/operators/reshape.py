"""Wide to long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.text import name_part


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def melt_parts(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    name: str,
    value: str,
    part: int,
    sep: str = "_",
) -> DataFrame:
    """Melt and keep one part of the melted column's name."""
    return melt(df, ids, values, name, value).withColumn(name, name_part(F.col(name), part, sep))


def melt_measures(
    df: DataFrame,
    ids: Sequence[str],
    groups: Sequence[str],
    measures: Mapping[str, str],
    name: str = "region",
) -> DataFrame:
    """One row per group with several measures side by side.

    ``measures`` maps an output column to a pattern for its input column, such as
    ``{"proportion": "{}_prop", "ymin": "{}_ymin"}``. One narrow pass stands for
    a melt per measure and the joins between them.
    """
    structs = [
        F.struct(
            F.lit(group).alias(name),
            *[F.col(pattern.format(group)).alias(out) for out, pattern in measures.items()],
        )
        for group in groups
    ]
    return df.select(*ids, F.inline(F.array(*structs)))
