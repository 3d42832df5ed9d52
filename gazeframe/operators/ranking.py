"""Row numbers within a key that stay parallel however many rows the key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.operators.relational import join_null_safe
from gazeframe.session import stored

#: ``monotonically_increasing_id`` holds the partition above these bits, the row in it below.
ROW_BITS = 33


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` sorted by ``keys`` and ``order`` over all its partitions, as a table with ``_part`` and ``_row``.

    Partitions are ranges, so a key of any size is cut at values of ``order``; a NULL key or value comes first.
    ``_row`` grows in this order, by one from row to row inside a partition. The table is written to the shared
    folder when this is called: what is counted per partition and what it is joined to must be the same rows.
    """
    by = [*keys, *order]
    spread = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    numbered = spread.sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    return stored(numbered.withColumn("_part", F.shiftright("_row", ROW_BITS)), "sorted")


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "trial_number", parts: int | None = None
) -> DataFrame:
    """1-based row number within ``keys`` (over all rows without any) in the order of ``order``.

    Rows are sorted into ranges; the rows of a key in earlier ranges are added up and joined to each (key, range),
    so no task sees a whole key and nothing depends on its size. A NULL key is a key, NULLs in ``order`` come
    first. ``order`` has to be unique within a key for the numbers to be reproducible.
    """
    keys = list(keys)
    table = placed(df, keys, order, parts)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        table.groupBy(*keys, "_part")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    number = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return join_null_safe(table, pieces, [*keys, "_part"]).withColumn(out, number.cast("int")).select(*df.columns, out)


def seeded_order(
    df: DataFrame,
    worker: str,
    item: str,
    seed: str,
    out: str = "presentation",
    parts: int | None = None,
) -> DataFrame:
    """Reproducible random order of the items of each worker."""
    text = F.concat_ws(":", F.col(worker).cast("string"), F.col(item).cast("string"), F.lit(seed))
    hashed = df.withColumn("_digest", F.md5(text))
    return number_within(hashed, [worker], ["_digest", item], out, parts).drop("_digest")


def assigned_list(worker: Column, n_lists: int, seed: str) -> Column:
    """List number 1..n of a worker by hash."""
    digest = F.md5(F.concat_ws(":", worker.cast("string"), F.lit(seed)))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return (number % n_lists + 1).cast("int")
