"""NULL rules of R on Spark columns.

``case_when`` and ``filter`` treat a NULL test as false, which is Spark's own
rule. ``ifelse`` returns NULL for a NULL test; that is ``r_ifelse`` here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r_ifelse(test: Column, yes, no) -> Column:
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(test, yes).when(~test, no)


def indicator(test: Column) -> Column:
    """0/1 with NULL kept as NULL."""
    return test.cast("int")


def flag(test: Column) -> Column:
    """0/1 with NULL counted as 0."""
    return F.coalesce(test, F.lit(False)).cast("int")


def one_of_two(value: Column, first: Column, second: Column) -> Column:
    """1 when ``value`` is either answer; NULL when a needed test is NULL.

    A match on ``first`` decides alone, so a trial without a second answer still
    scores 1; a miss on ``first`` with no second answer stays NULL.
    """
    return r_ifelse(value == first, F.lit(1), r_ifelse(value == second, 1, 0))


def r_round(value: Column, digits: int = 0) -> Column:
    """Half-even rounding."""
    return F.bround(value, digits)
