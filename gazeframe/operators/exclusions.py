"""Accuracy rates and the exclusion funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.operators.relational import exclude

# Trials a rate is taken over, lowest rate kept.
SCORED_TRIALS = 48
LEAST_RATE = 0.95


def accuracy(
    trials: DataFrame,
    keys: Sequence[str] = ("workerid",),
    correct: str = "selection_correct",
    scored: Column | None = None,
    divisor: int = SCORED_TRIALS,
) -> DataFrame:
    """Number correct ``n`` and rate ``correct`` per worker.

    ``scored`` keeps only some trials, as when practice does not count. The
    divisor is fixed by design, so a rate can pass 1.
    """
    kept = trials if scored is None else trials.where(scored)
    tally = F.coalesce(F.sum(correct), F.lit(0)).cast("bigint").alias("n")
    return kept.groupBy(*keys).agg(tally).withColumn("correct", F.col("n") / divisor)


def inaccurate(rates: DataFrame, least: float = LEAST_RATE) -> DataFrame:
    return rates.where(F.col("correct") < least)


def apply_exclusions(
    trials: DataFrame,
    scored: Column,
    wanted: Column,
    worker: str = "workerid",
    correct: str = "selection_correct",
    least: float = LEAST_RATE,
    divisor: int = SCORED_TRIALS,
) -> DataFrame:
    """Trials left after accuracy, wrong-selection and trial-type exclusions."""
    listed = inaccurate(accuracy(trials, [worker], correct, scored, divisor), least)
    kept = exclude(trials, listed.select(worker), worker)
    return kept.where((F.col(correct) == 1) & wanted)


# Stage names in the order exclusions are applied.
STAGES = ("loaded", "accurate_workers", "correct_trials", "wanted_trials")


def exclusion_funnel(
    trials: DataFrame,
    scored: Column,
    wanted: Column,
    worker: str = "workerid",
    correct: str = "selection_correct",
    least: float = LEAST_RATE,
    divisor: int = SCORED_TRIALS,
) -> DataFrame:
    """Rows and workers left after each stage, with their share of the rows loaded.

    All stages are counted per worker in one aggregation and then added up, so
    the trials are read once and never joined to the list of excluded workers.
    """
    ok = F.col(correct) == 1
    rate = F.sum(F.when(scored, F.col(correct))) / divisor
    # A worker without scored trials has no rate and is not excluded.
    keep = F.coalesce(~(F.col("_rate") < least), F.lit(True)) | F.col("_unrated")
    per_worker = trials.groupBy(worker).agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(ok).alias("_ok"),
        F.count_if(ok & wanted).alias("_wanted"),
        F.coalesce(rate, F.lit(0.0)).alias("_rate"),
        (F.count_if(scored) == 0).alias("_unrated"),
    )
    sizes = {
        "loaded": F.col("_all"),
        "accurate_workers": F.when(keep, F.col("_all")).otherwise(0),
        "correct_trials": F.when(keep, F.col("_ok")).otherwise(0),
        "wanted_trials": F.when(keep, F.col("_wanted")).otherwise(0),
    }
    totals = per_worker.agg(
        *[F.sum(size).alias(f"rows_{s}") for s, size in sizes.items()],
        *[F.count_if(size > 0).alias(f"workers_{s}") for s, size in sizes.items()],
    )
    stages = [
        F.struct(
            F.lit(number).alias("stage_no"),
            F.lit(stage).alias("stage"),
            F.col(f"rows_{stage}").alias("rows_left"),
            F.col(f"workers_{stage}").alias("workers_left"),
            (F.col(f"rows_{stage}") / F.col("rows_loaded")).alias("share_left"),
        )
        for number, stage in enumerate(STAGES, start=1)
    ]
    return totals.select(F.inline(F.array(*stages)))
