"""Descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.operators.ranking import placed
from gazeframe.operators.relational import join_null_safe


def counts(df: DataFrame, *cols: str, keep_null: bool = False) -> DataFrame:
    """Rows per value; rows with a NULL do not count unless asked for."""
    kept = df if keep_null else df.dropna(subset=list(cols))
    return kept.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def cross_table(df: DataFrame, rows: str, cols: str, levels: Sequence[str]) -> DataFrame:
    """Counts of two columns with one result column per level, 0 where none occurs."""
    tally = [F.count_if(F.col(cols) == level).alias(str(level)) for level in levels]
    return df.dropna(subset=[rows, cols]).groupBy(rows).agg(*tally)


def shares(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value and their share of all counted rows."""
    table = counts(df, *cols)
    total = table.agg(F.sum("n").alias("total"))
    return table.withColumn("share", F.col("n") / total.scalar())


def mean_sd(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def group_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(value).alias(f"mean_{value}") for value in values])


def histogram(df: DataFrame, value: str, low: float, width: float) -> DataFrame:
    """Rows per equal-width bin, labelled by its lower edge."""
    edge = F.floor((F.col(value) - low) / width) * width + low
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(edge.cast("double").alias("bin_start"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_combinations(df: DataFrame, *cols: str) -> DataFrame:
    """Number of different combinations, NULL counted as a value."""
    return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("n_combinations"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    out: str = "quantiles",
    mean: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key as an array, and the mean if it is named.

    Rows are reduced to distinct values with their counts and sorted into ranges; counts per (key, range) tell
    which range holds a wanted rank, and only these ranges are added up value by value. So no buffer or task
    grows with a key. A NULL key is a key; NULL values do not count. The sorted table is written when this is
    called.
    """
    group = list(keys) or ["_all"]
    known = df.where(F.col(value).isNotNull()).select(
        *(keys or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v")
    )
    cells = placed(known.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")), group, ["_v"], parts)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sizes = (
        cells.groupBy(*group, "_part")
        .agg(F.sum("_c").alias("_in"))
        .withColumn("_lo", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
        .withColumn("_n", F.sum("_in").over(whole))
    )
    ranks = [
        F.struct(F.lit(i).alias("_i"), ((F.col("_n") - 1) * float(p)).alias("_pos"))
        for i, p in enumerate(probs)
    ]
    wanted = (
        sizes.select("*", F.inline(F.array(*ranks)))
        .select("*", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_rank"))
        .where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_in")))
        .distinct()
    )
    needed = wanted.groupBy(*group, "_part", "_lo").agg(
        F.collect_set(F.struct("_i", "_pos", "_rank")).alias("_asked")
    )
    upto = Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        join_null_safe(cells, needed, [*group, "_part"])
        .withColumn("_end", F.col("_lo") + F.sum("_c").over(upto))
        .select(*group, "_v", "_c", "_end", F.inline("_asked"))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
    )
    low = F.min("_v")
    between = low + (F.max("_v") - low) * (F.first("_pos") - F.floor(F.first("_pos")))
    each = found.groupBy(*group, "_i").agg(between.alias("_q"))
    result = each.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(out)
    )
    if not mean:
        return result.select(*keys, out)
    means = cells.groupBy(*group).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias(mean))
    return join_null_safe(result, means, group).select(*keys, out, mean)


SUMMARY = ("min_value", "q1", "median", "mean", "q3", "max_value")


def six_numbers(df: DataFrame, value: str, keys: Sequence[str] = (), **options) -> DataFrame:
    """Minimum, quartiles, mean and maximum per key."""
    keys = list(keys)
    found = quantiles(df, keys, value, (0, 0.25, 0.5, 0.75, 1), "_q", "mean", **options)
    places = {name: i for i, name in enumerate(n for n in SUMMARY if n != "mean")}
    picks = [F.col(n) if n == "mean" else F.col("_q")[places[n]].alias(n) for n in SUMMARY]
    return found.select(*keys, *picks)


def time_ranges(df: DataFrame, keys: Sequence[str], value: str, **options) -> DataFrame:
    """Minimum, mean, median and maximum per key."""
    return six_numbers(df, value, keys, **options).drop("q1", "q3")
