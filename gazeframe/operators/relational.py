"""Row filters, distinct projections and simple joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calibration cutoff, smallest window, AOIs that are no answer.
CALIBRATION_CUTOFF = 50
MIN_WINDOW = (1280, 750)
CENTER_AOIS = ("AOI5", "AOI6")


def settle(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add costly columns that later filters read instead of computing again.

    A filter on a projected column is pushed below the projection with the whole
    expression copied into it, once per use. Columns that come out of a one-row
    generator stay columns.
    """
    fields = [column.alias(name) for name, column in columns.items()]
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def exclude(df: DataFrame, listed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``listed``; a NULL in the list excludes nothing.

    AQE broadcasts the list when its measured size allows and otherwise splits a
    hot key of ``df`` across tasks.
    """
    return df.join(listed, on, "left_anti")


def with_any_look(df: DataFrame, regions: Sequence[str], suffix: str = "_look") -> DataFrame:
    """Rows that look at one of the regions; this sets the denominator of proportions."""
    test = F.lit(False)
    for region in regions:
        test = test | (F.col(f"{region}{suffix}") == 1)
    return df.where(test)


def calibrated(accuracy: Column, cutoff: float = CALIBRATION_CUTOFF) -> Column:
    return accuracy >= cutoff


def large_enough(width: Column, height: Column, least: tuple[int, int] = MIN_WINDOW) -> Column:
    return (width >= least[0]) & (height >= least[1])


def drop_clicks(clicks: Column, rejected: Sequence[str] = CENTER_AOIS) -> Column:
    """Click list without the AOIs that do not count as an answer."""
    barred = F.array(*[F.lit(aoi) for aoi in rejected])
    return F.filter(clicks, lambda click: ~F.array_contains(barred, click))


def drop_null_predictions(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def left_join_renamed(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join to a dimension whose key has another name."""
    return df.join(dim.withColumnRenamed(dim_key, key), key, "left")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left join on ``keys`` with NULL equal to NULL; the keys of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])
