"""The incremental choice study: click lists to selections per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.nulls import one_of_two, r_ifelse
from gazeframe.functions.text import last_word, split_fixed, strip_list_text
from gazeframe.operators.exclusions import apply_exclusions
from gazeframe.operators.reshape import melt

# Click columns and the analysis window each click belongs to.
CLICKS = ("click1", "click2", "click3", "click4")
WINDOW_OF_CLICK = {
    "click1": "baseline",
    "click2": "gender",
    "click3": "determiner+name",
    "click4": "noun",
}
ANSWERS = ("target1", "target2", "competitor1", "competitor2")


def wide_clicks(trials: DataFrame, names: Sequence[str] = CLICKS) -> DataFrame:
    """Response list text to one column per click, and the item of the instruction."""
    others = [F.col(c) for c in trials.columns if c != "response"]
    clicks = split_fixed(strip_list_text(F.col("response")), names)
    return trials.select(*others, *clicks).withColumn("item", last_word(F.col("instruction3")))


def final_click_correct(wide: DataFrame) -> DataFrame:
    """``selection_correct`` of the last click, compared as numbers."""
    number = [F.col(c).try_cast("double") for c in (CLICKS[-1], "target1", "target2")]
    return wide.withColumn("selection_correct", one_of_two(*number))


def analysed_trials(wide: DataFrame, **options) -> DataFrame:
    """Correct experimental trials of accurate workers; practice does not count as accuracy."""
    kind = F.col("ExpFiller")
    scored = final_click_correct(wide)
    return apply_exclusions(scored, scored=kind != "Prac", wanted=kind == "Exp", **options)


def long_clicks(wide: DataFrame, keep: Sequence[str], names: Sequence[str] = CLICKS) -> DataFrame:
    """One row per click with target, competitor and distractor flags."""
    rows = melt(wide, [*keep, *ANSWERS], names, "click_number", "location")
    location = F.col("location")
    target = one_of_two(location, F.col("target1"), F.col("target2"))
    competitor = one_of_two(location, F.col("competitor1"), F.col("competitor2"))
    flagged = rows.withColumns({"target_look": target, "competitor_look": competitor})
    distractor = r_ifelse(
        F.col("target_look") == 1, F.lit(0), r_ifelse(F.col("competitor_look") == 1, F.lit(0), F.lit(1))
    )
    return flagged.withColumn("distractor_look", distractor).drop(*ANSWERS)
