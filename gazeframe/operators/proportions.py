"""Look and selection proportions, log-ratio scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.scores import SMOOTH, log_ratio, log_ratio_outer
from gazeframe.operators.relational import with_any_look

REGIONS = ("target", "competitor", "center")


def region_counts(
    looks: DataFrame,
    keys: Sequence[str],
    regions: Sequence[str] = REGIONS,
    require: Sequence[str] | None = None,
    suffix: str = "_look",
) -> DataFrame:
    """Rows ``n`` per key, and per region known flags ``n_<region>`` and hits ``k_<region>``.

    ``require`` names the regions one of which a row has to look at; None keeps
    all rows. Rows are summed before the shuffle, so few rows per key travel.
    """
    kept = looks if require is None else with_any_look(looks, require, suffix)
    flags = {region: F.col(f"{region}{suffix}") for region in regions}
    known = [F.count(flag).alias(f"n_{region}") for region, flag in flags.items()]
    hits = [F.sum(flag.cast("bigint")).alias(f"k_{region}") for region, flag in flags.items()]
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *known, *hits)


def add_proportions(
    counts: DataFrame, regions: Sequence[str] = REGIONS, out: str = "{}_prop"
) -> DataFrame:
    """Share of hits among the known flags, NULL where none is known."""
    return counts.withColumns(
        {out.format(r): F.try_divide(F.col(f"k_{r}"), F.col(f"n_{r}")) for r in regions}
    )


def look_proportions(
    looks: DataFrame,
    keys: Sequence[str],
    regions: Sequence[str] = REGIONS,
    require: Sequence[str] | None = None,
    suffix: str = "_look",
) -> DataFrame:
    """``<region>_prop`` per key, with the counts kept for intervals."""
    return add_proportions(region_counts(looks, keys, regions, require, suffix), regions)


def proportions_by_sets(
    looks: DataFrame,
    key_sets: Sequence[Sequence[str]],
    regions: Sequence[str] = REGIONS,
    require: Sequence[str] | None = None,
    suffix: str = "_look",
) -> DataFrame:
    """Proportions of several key sets with the same denominator rule.

    The finest cells are counted once and every set is rolled up from them, so
    rows are read and shuffled once. ``key_set`` names the set of a result row.
    """
    every = list(dict.fromkeys(key for keys in key_sets for key in keys))
    cells = region_counts(looks, every, regions, require, suffix)
    counted = ["n", *[f"{c}_{r}" for r in regions for c in ("n", "k")]]
    numbers = [F.sum(c).alias(c) for c in counted]
    labels = F.lit(None).cast("string")
    for keys in key_sets:
        mask = sum(0 if key in keys else 1 << (len(every) - 1 - i) for i, key in enumerate(every))
        labels = F.when(F.grouping_id() == mask, ",".join(keys)).otherwise(labels)
    sets = [[F.col(key) for key in keys] for keys in key_sets]
    grouped = cells.groupingSets(sets, *[F.col(key) for key in every])
    return add_proportions(grouped.agg(labels.alias("key_set"), *numbers), regions)


def two_stage_score(
    looks: DataFrame,
    unit: Sequence[str],
    cell: Sequence[str],
    target: Column,
    competitor: Column,
    smooth: float = SMOOTH,
    rule: str = "both",
    reverse: bool = False,
) -> DataFrame:
    """Log ratio of mean looks per unit and cell: the rows a score mean is taken over.

    ``rule="both"`` smooths both means, ``rule="outer"`` the denominator and
    then the ratio.
    """
    means = looks.groupBy(*cell, *unit).agg(F.avg(target).alias("_p"), F.avg(competitor).alias("_q"))
    p, q = F.col("_p"), F.col("_q")
    score = log_ratio(p, q, smooth, reverse) if rule == "both" else log_ratio_outer(p, q, smooth)
    return means.withColumn("score", score).drop("_p", "_q")


def score_means(scores: DataFrame, cell: Sequence[str]) -> DataFrame:
    return scores.groupBy(*cell).agg(
        F.avg("score").alias("mean_score"), F.count("score").alias("n_units")
    )


def one_stage_score(
    looks: DataFrame,
    cell: Sequence[str],
    target: Column,
    competitor: Column,
    smooth: float = SMOOTH,
    reverse: bool = False,
) -> DataFrame:
    """Log ratio of the mean looks of each cell."""
    means = looks.groupBy(*cell).agg(F.avg(target).alias("_p"), F.avg(competitor).alias("_q"))
    score = log_ratio(F.col("_p"), F.col("_q"), smooth, reverse)
    return means.select(*cell, score.alias("score"))
