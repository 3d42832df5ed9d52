"""Log ratios, p-value classes and category recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smoothing constant of the log ratio.
SMOOTH = 1e-8


def log_ratio(p: Column, q: Column, smooth: float = SMOOTH, reverse: bool = False) -> Column:
    """``ln((p + s) / (q + s))``; ``reverse`` gives ``ln((q + s) / (p + s))``."""
    top, bottom = (q, p) if reverse else (p, q)
    return F.ln((top + smooth) / (bottom + smooth))


def log_ratio_outer(p: Column, q: Column, smooth: float = SMOOTH) -> Column:
    """The other smoothing rule: the denominator and then the ratio get ``s``."""
    return F.ln(p / (q + smooth) + smooth)


def p_class(p: Column) -> Column:
    """Class label of a p-value; above .05 the value rounded to two digits."""
    shown = F.regexp_replace(F.bround(p, 2).cast("string"), r"\.0$", "")
    return (
        F.when(p > 0.05, F.concat(F.lit(">"), shown))
        .when(p < 0.0001, "<.0001")
        .when(p < 0.001, "<.001")
        .when(p < 0.01, "<.01")
        .when(p <= 0.05, "<.05")
    )


def recode(value: Column, renames: Mapping[str, str]) -> Column:
    """Rename or merge categories; others stay as they are."""
    chain = None
    for old, new in renames.items():
        chain = F.when(value == old, new) if chain is None else chain.when(value == old, new)
    return value if chain is None else chain.otherwise(value)


def level_order(value: Column, levels: Sequence[str]) -> Column:
    """1-based position of a category in ``levels``, NULL when it is not there."""
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), value)
    return F.when(position > 0, position.cast("int"))


def band(mean: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds of an interval given as distances below and above the mean."""
    return mean - low, mean + high
