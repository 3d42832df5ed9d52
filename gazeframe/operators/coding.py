"""Centring and contrast coding of model columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.scores import level_order
from gazeframe.operators.ranking import number_within
from gazeframe.operators.relational import join_null_safe


def with_alphabetical_code(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the 1-based place of each row's category among the sorted categories; NULL stays NULL.

    Categories are told apart, numbered by prefix sums and joined back, so there may be any number of them.
    """
    levels = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_level")).distinct()
    coded = number_within(levels, [], ["_level"], out)
    return df.join(coded, F.col(col) == F.col("_level"), "left").drop("_level")


def category_code(col: str, levels: Sequence[str]) -> Column:
    """1-based code of a category in the order of ``levels``."""
    return level_order(F.col(col), levels)


def centre(
    df: DataFrame, columns: Mapping[str, Column | str], keys: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Add columns less their mean, over all rows or per key.

    ``columns`` maps a new name to a numeric column or expression. The means are
    one small aggregate: a scalar subquery over all rows, or a join per key, where
    a NULL key is a key. A weight makes them means of weighted rows.
    """
    keys = list(keys)
    values = {n: (F.col(c) if isinstance(c, str) else c) for n, c in columns.items()}

    def mean(value: Column) -> Column:
        if weight is None:
            return F.avg(value)
        counted = F.when(value.isNotNull(), F.col(weight))
        return F.sum(value * F.col(weight)) / F.sum(counted)

    means = {name: mean(value).alias(f"_mean_{name}") for name, value in values.items()}
    if keys:
        joined = join_null_safe(df, df.groupBy(*keys).agg(*means.values()), keys)
        added = {name: value - F.col(f"_mean_{name}") for name, value in values.items()}
        return joined.withColumns(added).drop(*[f"_mean_{name}" for name in values])
    # One subquery for all means: the rows are read once more, not once per column.
    table = df.agg(F.struct(*means.values()).alias("_means")).scalar()
    return df.withColumns(
        {name: value - table.getField(f"_mean_{name}") for name, value in values.items()}
    )


def dummies(col: str, levels: Sequence[str], reference: str) -> dict[str, Column]:
    """0/1 column ``<col>_<level>`` for each level but the reference."""
    return {
        f"{col}_{level}": (F.col(col) == level).cast("int") for level in levels if level != reference
    }


def interactions(left: Sequence[str], right: Sequence[str]) -> dict[str, Column]:
    """Products ``a__b`` of two sets of columns."""
    return {f"{a}__{b}": F.col(a) * F.col(b) for a in left for b in right}
