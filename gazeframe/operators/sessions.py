"""Trials as sessions of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trial_sessions(df: DataFrame, keys: Sequence[str], time_ms: Column, gap_ms: int) -> DataFrame:
    """Sessions per key: a pause of at least ``gap_ms`` starts a new one.

    Samples are first reduced to slices of ``gap_ms``. Two samples of one slice
    lie less than a gap apart and so share a session, hence only slices are
    ordered: a hot worker costs one row per slice of time, not one per sample.
    """
    keys = list(keys)
    slices = (
        df.select(*keys, time_ms.alias("_t"))
        .groupBy(*keys, F.floor(F.col("_t") / gap_ms).alias("_slice"))
        .agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy(*keys).orderBy("_slice")
    pause = F.col("_from") - F.lag("_to").over(order)
    marked = slices.withColumn("_new", F.coalesce((pause >= gap_ms).cast("int"), F.lit(1)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("session_no", F.sum("_new").over(upto))
        .groupBy(*keys, "session_no")
        .agg(
            F.min("_from").alias("start_ms"),
            F.max("_to").alias("end_ms"),
            F.sum("_n").alias("n_samples"),
        )
    )
