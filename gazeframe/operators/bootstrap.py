"""Percentile bootstrap intervals of means.

Resampling a group of ``n`` rows depends only on how often each distinct value
occurs. So rows are first reduced to ``(keys, value, count)`` inside Spark's
aggregation, and only these counts are resampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeframe.operators.relational import join_null_safe
from gazeframe.session import stored

RESAMPLES = 1000
TAILS = (0.025, 0.975)
#: Distinct values of a part of a group.
PART_VALUES = 4096

# Cumulative Poisson(1) probabilities of the weights 0 to 4.
POISSON_CUTS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)


def _generator(*parts: int) -> np.random.Generator:
    return np.random.default_rng([part & 0xFFFFFFFFFFFFFFFF for part in parts])


def binomial_quantiles(size: int, ones: int, tails: Sequence[float] = TAILS) -> np.ndarray:
    """Quantiles of the number of ones in ``size`` draws with replacement from rows of which ``ones`` are ones."""
    if ones in (0, size):
        return np.full(len(tails), float(ones))
    p = ones / size
    # All but some 1e-30 of the draws lie this near; weights follow from one another.
    reach = math.ceil(12 * math.sqrt(size * p * (1 - p))) + 50
    low = max(0, ones - reach)
    at = np.arange(low, min(size, ones + reach) + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((size - at[:-1]) / at[1:]) + math.log(p / (1 - p)))])
    shares = np.cumsum(np.exp(logs - logs.max()))
    return low + np.searchsorted(shares / shares[-1], tails).astype(float)


def binomial_intervals(
    counts: DataFrame,
    keys: Sequence[str],
    hits: Mapping[str, tuple[str, str]],
    resamples: int | None = RESAMPLES,
    seed: int = 1,
) -> DataFrame:
    """Add ``<name>_CILow`` and ``<name>_CIHigh`` for 0/1 columns given as counts.

    ``hits`` maps a result name to the columns with its number of ones and its
    number of known flags. The
    resampled mean of a 0/1 group is Binomial(n, p)/n exactly. Rows are
    independent, so this adds no shuffle. The generator starts from the key,
    hence a recomputed row gives the same interval. ``resamples=None`` gives the
    bounds that more and more resamples tend to, the quantiles of that law.
    """
    names = list(hits)
    schema = T.StructType(list(counts.schema.fields))
    for name in names:
        schema.add(f"{name}_CILow", T.DoubleType()).add(f"{name}_CIHigh", T.DoubleType())
    keyed = counts.withColumn("_key", F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            out = batch.drop(columns="_key")
            for number, name in enumerate(names):
                low = np.full(len(batch), np.nan)
                high = np.full(len(batch), np.nan)
                ones_column, size_column = hits[name]
                rows = zip(batch["_key"], batch[ones_column], batch[size_column])
                for i, (key, ones, size) in enumerate(rows):
                    if pd.isna(ones) or size == 0:
                        continue
                    size = int(size)
                    p = ones / size
                    if resamples is None:
                        bounds = binomial_quantiles(size, int(ones)) / size
                    else:
                        means = _generator(seed, number, int(key)).binomial(size, p, resamples) / size
                        bounds = np.quantile(means, TAILS)
                    low[i], high[i] = p - bounds[0], bounds[1] - p
                out[f"{name}_CILow"], out[f"{name}_CIHigh"] = low, high
            yield out

    return keyed.mapInPandas(draw, schema)


def _group_sizes(cells: DataFrame, group: list[str], part_values: int) -> DataFrame:
    """Rows, mean, and the depth of the tree that cuts a group into parts of some ``part_values`` distinct values."""
    depth = F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / part_values)), F.lit(0)).cast("int")
    return cells.groupBy(*group).agg(
        F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), depth.alias("_depth")
    )


def _paths(totals: DataFrame, group: list[str]) -> DataFrame:
    """Per part, the steps from the group to it: (level, node, rows of the left half, rows of the node, went right).

    ``totals`` has ``_part``, ``_depth`` and ``_m`` rows of each part. Nodes of a level are parts cut to as many
    leading bits; one that has no rows is on no path.
    """
    level = F.sequence(F.lit(0), F.col("_depth"))
    steps = totals.select(*group, "_part", "_depth", "_m", F.explode(level).alias("_level")).withColumn(
        "_node", F.expr("shiftright(_part, _depth - _level)")
    )
    nodes = steps.groupBy(*group, "_level", "_node").agg(F.sum("_m").alias("_rows"))
    below = steps.where("_level > 0").withColumns(
        {"_up": F.col("_level") - 1, "_parent": F.shiftright("_node", 1), "_right": F.col("_node") % 2 == 1}
    )
    parents = nodes.withColumnsRenamed({"_level": "_up", "_node": "_parent", "_rows": "_all_rows"})
    known = join_null_safe(below, parents, [*group, "_up", "_parent"])
    own = join_null_safe(known, nodes, [*group, "_level", "_node"])
    left = F.when(F.col("_right"), F.col("_all_rows") - F.col("_rows")).otherwise(F.col("_rows"))
    step = F.struct(F.col("_up").alias("level"), F.col("_parent").alias("node"), left.alias("left"), F.col("_all_rows").alias("rows"), F.col("_right").alias("right"))
    return own.groupBy(*group, "_part").agg(F.array_sort(F.collect_list(step)).alias("_path"))


def _part_sums(parts: DataFrame, group: list[str], resamples: int, seed: int) -> DataFrame:
    """Sum of the values that each replicate draws from each part."""
    schema = T.StructType([parts.schema[g] for g in group])
    schema.add("_part", T.LongType()).add("_sums", T.ArrayType(T.DoubleType()))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.to_dict("records"):
                key = int(row["_key"])
                drawn = np.full(resamples, int(row["n"]), np.int64)
                # Every part of a node draws the same split of it, as generators start from the node.
                for step in row["_path"] if row["_path"] is not None else ():
                    rng = _generator(seed, key, step["level"], step["node"])
                    left = rng.binomial(drawn, step["left"] / step["rows"])
                    drawn = drawn - left if step["right"] else left
                values, times = np.array(row["_values"]), np.array(row["_times"], float)
                share, rng = times / times.sum(), _generator(seed, key, -1, int(row["_part"]))
                sums = np.empty(resamples)
                width = max(1, 2_000_000 // len(values))
                for start in range(0, resamples, width):
                    some = slice(start, start + width)
                    sums[some] = rng.multinomial(drawn[some], share) @ values
                made.append((*[row[g] for g in group], row["_part"], sums))
            yield pd.DataFrame(made, columns=schema.names)

    return parts.mapInPandas(draw, schema)


def _added(sums: DataFrame, group: list[str]) -> DataFrame:
    """Element-wise sums of the arrays of a group, in the order of their parts."""
    ordered = F.array_sort(F.collect_list(F.struct("_part", "_sums")))
    added = F.aggregate(
        F.slice(ordered, F.lit(2), F.size(ordered)),
        F.get(ordered, F.lit(0))["_sums"],
        lambda total, part: F.zip_with(total, part["_sums"], lambda a, b: a + b),
    )
    return sums.groupBy(*group).agg(added.alias("_sums"))


def bootstrap_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    resamples: int = RESAMPLES,
    seed: int = 1,
    part_values: int = PART_VALUES,
) -> DataFrame:
    """Mean of ``value`` per key with its bootstrap distances ``CILow`` and ``CIHigh``, and rows ``n``.

    Every replicate draws n rows with replacement, whatever the size of the group: a multinomial draw over the
    distinct values. A group is dealt by hash into parts of some ``part_values`` distinct values. The number of
    rows that a replicate takes from a part is drawn down a binary tree over the parts, a binomial split at each
    node, and then dealt to the part's values; together this is the multinomial draw exactly. No task holds more
    than a part, or the replicates' sums of 1,024 parts. A NULL key is a key; NULL values do not count. The
    numbers depend on seed, key and ``part_values`` alone. The counts of distinct values are written when this
    is called.
    """
    group = list(keys) or ["_all"]
    known = df.where(F.col(value).isNotNull()).select(
        *(keys or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v")
    )
    cells = stored(known.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")), "cells")
    sizes = _group_sizes(cells, group, part_values)
    dealt = join_null_safe(cells, sizes.select(*group, "n", "_depth"), group).withColumn(
        "_part", F.expr("pmod(xxhash64(_v), shiftleft(1L, _depth))")
    )
    parts = dealt.groupBy(*group, "_part", "_depth", "n").agg(
        F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_cells"), F.sum("_c").alias("_m")
    )
    paths = _paths(dealt.groupBy(*group, "_part", "_depth").agg(F.sum("_c").alias("_m")), group)
    asked = join_null_safe(parts, paths, [*group, "_part"], "left").select(
        *group,
        "_part",
        "n",
        "_path",
        F.xxhash64(*group).alias("_key"),
        F.col("_cells._v").alias("_values"),
        F.col("_cells._c").alias("_times"),
    )
    sums = _part_sums(asked, group, resamples, seed)
    some = _added(sums.withColumn("_some", F.shiftright("_part", 10)), [*group, "_some"])
    replicates = _added(some.withColumnRenamed("_some", "_part"), group)
    means = join_null_safe(replicates, sizes.drop("_depth"), group).withColumn(
        "_means", F.array_sort(F.transform("_sums", lambda s: s / F.col("n")))
    )

    def tail(share: float) -> Column:
        at = share * (resamples - 1)
        low, high = F.col("_means")[math.floor(at)], F.col("_means")[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    return means.select(
        *keys, "mean", (F.col("mean") - tail(TAILS[0])).alias("CILow"), (tail(TAILS[1]) - F.col("mean")).alias("CIHigh"), "n"
    )


def digest_bootstrap(
    df: DataFrame, keys: Sequence[str], value: str, row_id: str, resamples: int = 50
) -> DataFrame:
    """Bootstrap whose weights any SQL engine can repeat.

    Replicate ``b`` weighs a row by the Poisson(1) quantile of eight hex digits
    of ``md5(row_id:b/4)``; one digest serves four replicates. Sums are built
    before the shuffle.
    """
    sums = []
    for replicate in range(resamples):
        block, part = divmod(replicate, 4)
        # Hex digits of fixed width sort like the numbers they write.
        digits = F.substring(F.col(f"_digest{block}"), part * 8 + 1, 8)
        weight = F.lit(0)
        for cut in POISSON_CUTS:
            weight = weight + (digits >= f"{math.ceil(cut * 2**32):08x}").cast("int")
        mean = F.sum(weight * F.col(value)) / F.sum(weight)
        sums.append(F.struct(F.lit(replicate).alias("replicate"), mean.alias("boot_mean")))
    digests = {
        f"_digest{block}": F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(block))))
        for block in range((resamples + 3) // 4)
    }
    wide = df.select(*keys, value, row_id).withColumns(digests)
    return wide.groupBy(*keys).agg(F.array(*sums).alias("_means")).select(*keys, F.inline("_means"))
