"""Time alignment columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken-word onsets in order, preview length, sample length.
ONSETS = ("click", "gender", "determiner", "name", "noun")
WINDOWS = ("preview", "baseline", "gender", "determiner", "name", "noun")
PREVIEW_MS = 1000
TRACKER_SAMPLE_MS = 15.9
SECOND_HALF_FROM_TRIAL = 31


def since_onset(
    elapsed: Column,
    first_sample: Column,
    onset_ms: Column,
    preview_ms: float = PREVIEW_MS,
    unit: float = 1,
) -> Column:
    """Milliseconds since a word onset; ``unit=1000`` for onsets kept in seconds."""
    onset = onset_ms if unit == 1 else onset_ms * unit
    return elapsed - first_sample - preview_ms - onset


def time_bin(t: Column, width: float) -> Column:
    return F.floor(t / width) * width


def window_label(since: Mapping[str, Column]) -> Column:
    """Window named by the next onset that is still ahead.

    ``since`` maps each of ``ONSETS`` to the time since that onset.
    """
    chain = F.when(since[ONSETS[0]] < 0, WINDOWS[0])
    for onset, window in zip(ONSETS[1:], WINDOWS[1:]):
        chain = chain.when(since[onset] < 0, window)
    return chain.otherwise(WINDOWS[-1])


def sample_to_ms(sample: Column, sample_ms: float = TRACKER_SAMPLE_MS) -> Column:
    return sample * sample_ms - PREVIEW_MS


def half(trial_number: Column) -> Column:
    return F.when(trial_number < SECOND_HALF_FROM_TRIAL, "first_half").otherwise("second_half")
