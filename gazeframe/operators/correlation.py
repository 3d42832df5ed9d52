"""Pearson correlation and fitted lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.tdist import t_two_sided_p
from gazeframe.operators.regression import coefficients, ols_fit


def correlation(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """``r``, its ``t`` and degrees of freedom over complete pairs, per key."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = F.corr(a, b)
    grouped = pairs.groupBy(*keys).agg(r.alias("r"), (F.count(F.lit(1)) - 2).alias("dof"))
    # A perfect fit has no finite t.
    spread = 1 - F.col("r") * F.col("r")
    t = F.col("r") * F.sqrt(F.col("dof") / F.when(spread > 0, spread))
    return grouped.withColumn("t", F.when(F.col("dof") > 0, t))


def with_p(df: DataFrame, t: str = "t", dof: str = "dof", out: str = "p") -> DataFrame:
    """Two-sided p-value beside each t."""
    return df.withColumn(out, t_two_sided_p(F.col(t), F.col(dof).cast("double")))


def fitted_line(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and share of variance explained, per facet."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def unit_slopes(df: DataFrame, y: str, x: str, unit: Sequence[str]) -> DataFrame:
    """Slope of each unit, the first stage of a two-stage random-slope summary."""
    return df.groupBy(*unit).agg(F.regr_slope(y, x).alias("slope"), F.count(y).alias("n"))


def unit_effects(df: DataFrame, y: str, xs: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """Term and ``estimate`` of every unit's own least-squares model of ``y`` on ``xs``, with its rows ``n``.

    The first stage of a two-stage summary of several random slopes. All units come out of one aggregation; an
    effect that a unit's rows cannot tell from earlier ones is NULL, so it is left out of the second stage.
    """
    return coefficients(ols_fit(df, y, xs, unit), xs, unit).select(*unit, "term", "estimate", "n")


def slope_summary(slopes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return slopes.groupBy(*keys).agg(
        F.avg("slope").alias("mean_slope"),
        F.stddev_samp("slope").alias("sd_slope"),
        F.count("slope").alias("n_units"),
    )
