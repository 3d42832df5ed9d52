"""Merging result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_sources(
    sources: Sequence[tuple[DataFrame, str]],
    id_col: str = "workerid",
    label_col: str = "speaker_cond",
) -> DataFrame:
    """Union of labelled sources, ids shifted past the largest id merged so far.

    Each shift is a sum of scalar subqueries over single sources, so every
    source is read in one narrow pass and nothing shuffles. Ids start at 0 or
    above, as worker ids do.
    """
    if not sources:
        raise ValueError("no sources")
    merged, shift = None, F.lit(0).cast("bigint")
    for df, label in sources:
        shifted = df.withColumn(id_col, F.col(id_col).cast("bigint") + shift).withColumn(
            label_col, F.lit(label)
        )
        merged = shifted if merged is None else merged.unionByName(shifted)
        widest = df.agg(F.coalesce(F.max(id_col).cast("bigint") + 1, F.lit(0)).alias("next"))
        shift = shift + widest.scalar()
    return merged


def stack(*frames: DataFrame) -> DataFrame:
    """Union of exports with the same columns, matched by name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
