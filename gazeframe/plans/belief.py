"""Explicit selections against looks, by item and analysis window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.nulls import r_ifelse
from gazeframe.functions.scores import recode
from gazeframe.functions.text import last_word
from gazeframe.operators.reshape import melt_measures

# Grain of the comparison, its regions, tracker windows to merge.
GRAIN = ("determiner", "size", "window", "item")
REGIONS = ("target", "competitor", "distractor")
WINDOW_OF_WORD = {"determiner": "determiner+name", "name": "determiner+name", "end": "noun"}
MERGED_DETERMINERS = {"two": "number", "three": "number"}


def tracked(exports: DataFrame) -> DataFrame:
    """Tracker samples with sight of the eye, with item and merged window."""
    return exports.where(F.col("TrackLoss") == "FALSE").withColumns(
        {
            "item": last_word(F.col("instruction")),
            "window": recode(F.col("whichword"), WINDOW_OF_WORD),
        }
    )


def gaze_flags() -> dict[str, Column]:
    """Distractor flags of a tracker sample; a NULL look leaves them NULL."""
    target, competitor, residue = (
        F.col(c) == 1 for c in ("targetlook", "competitorlook", "residuelook")
    )
    none = r_ifelse(target, F.lit(0), r_ifelse(competitor, F.lit(0), r_ifelse(residue, 0, 1)))
    return {
        "distractorlook": none,
        "targetdistractorlook": r_ifelse(target, F.lit(1), r_ifelse(none == 1, 1, 0)),
        "competitordistractorlook": r_ifelse(competitor, F.lit(1), r_ifelse(none == 1, 1, 0)),
    }


def item_means(df: DataFrame, flags: Mapping[str, str], keys: Sequence[str] = GRAIN) -> DataFrame:
    """Mean of each flag per item cell; ``flags`` maps a result name to a flag."""
    return df.groupBy(*keys).agg(*[F.avg(flag).alias(name) for name, flag in flags.items()])


def compare(selections: DataFrame, looks: DataFrame) -> DataFrame:
    """One row per item cell and region with both proportions.

    ``selections`` has ``Mean_<region>_selection``, ``looks`` has
    ``Mean_<region>_look``. Both are item-level aggregates.
    """
    both = selections.join(looks, list(GRAIN))
    long = melt_measures(
        both,
        GRAIN,
        REGIONS,
        {"prop_selections": "Mean_{}_selection", "prop_looks": "Mean_{}_look"},
        "Region",
    )
    return long.withColumn("determiner", recode(F.col("determiner"), MERGED_DETERMINERS))
