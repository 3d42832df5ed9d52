"""Parallel list columns to one row per sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.text import parse_list


def checked_zip(names: Sequence[str]) -> Column:
    """Array of structs from parallel array columns; unequal lengths raise an error.

    A row whose lists are all NULL gives NULL, which explodes to no row.
    """
    first, *rest = names
    same = F.lit(True)
    for name in rest:
        same = same & F.size(first).eqNullSafe(F.size(name))
    return F.when(same, F.arrays_zip(*names)).otherwise(
        F.raise_error(F.lit("parallel lists differ in length"))
    )


def explode_parallel(
    df: DataFrame, lists: Mapping[str, str], sep: str | None = None, position: str | None = None
) -> DataFrame:
    """One row per list position of several columns at once.

    ``lists`` maps a column to its item type. With ``sep`` the columns are list
    text, otherwise arrays. Lists of unequal length raise an error instead of
    being padded. The step is narrow: rows are only multiplied where they are.
    """
    parsed = {
        name: (parse_list(F.col(name), kind, sep) if sep else F.col(name).cast(f"array<{kind}>"))
        for name, kind in lists.items()
    }
    others = [name for name in df.columns if name not in lists]
    staged = df.select(*others, *[column.alias(name) for name, column in parsed.items()])
    zipped = checked_zip(list(lists))
    if position is None:
        # Straight from the generator, so that filters on trials pass below it.
        return staged.select(*others, F.inline(zipped))
    rows = staged.select(*others, F.posexplode(zipped).alias(position, "_item"))
    return rows.select(*others, position, *[F.col(f"_item.{name}").alias(name) for name in lists])
