"""Trial origins and onset alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.timebins import ONSETS, PREVIEW_MS, since_onset, time_bin, window_label

TRIAL = ("workerid", "slide_number")


def first_samples(
    samples: DataFrame,
    keys: Sequence[str] = TRIAL,
    mins: Mapping[str, str] = {"webgazer_time": "first_sample", "unixtlist": "first_unix"},
) -> DataFrame:
    """First sample time of each trial, one row per trial."""
    return samples.groupBy(*keys).agg(*[F.min(col).alias(out) for col, out in mins.items()])


def with_first_sample(
    samples: DataFrame,
    keys: Sequence[str] = TRIAL,
    mins: Mapping[str, str] = {"webgazer_time": "first_sample", "unixtlist": "first_unix"},
    origin: DataFrame | None = None,
) -> DataFrame:
    """Samples with the first time of their trial beside them.

    The minimum is reduced before it is shuffled, and AQE broadcasts the trial
    table or splits a hot trial in the join, so no task holds a whole trial, as
    a window over the trial would. ``origin`` is the table the first samples are
    taken from: ``samples`` themselves by default.
    """
    source = samples if origin is None else origin
    return samples.join(first_samples(source, keys, mins), list(keys), "left")


def align(
    df: DataFrame,
    elapsed: str = "webgazer_time",
    first: str = "first_sample",
    shift: int = 0,
    preview_ms: float = PREVIEW_MS,
    units: Mapping[str, float] = {},
    onsets: Sequence[str] = ONSETS,
    unix: tuple[str, str] = ("unixtlist", "first_unix"),
) -> DataFrame:
    """Add ``relative_time`` and ``time_rel_<onset>_onset`` columns, and ``relative_time_unix``.

    The last is by the other clock of the samples, where ``unix`` names columns of ``df``.

    ``shift=200`` reads the shifted onset columns; ``units`` gives a factor for
    onsets that are kept in seconds.
    """
    suffix = f"_{shift}shift" if shift else ""
    added = {"relative_time": F.col(elapsed) - F.col(first)}
    if set(unix) <= set(df.columns):
        added["relative_time_unix"] = F.col(unix[0]) - F.col(unix[1])
    for onset in onsets:
        added[f"time_rel_{onset}_onset"] = since_onset(
            F.col(elapsed),
            F.col(first),
            F.col(f"{onset}_onset_ms{suffix}"),
            preview_ms,
            units.get(onset, 1),
        )
    return df.withColumns(added)


def bin_time(
    df: DataFrame,
    time: str = "time_rel_click_onset",
    width: float = 100,
    low: float = 0,
    high: float = 4000,
    low_open: bool = False,
    out: str = "binned_time_relative",
) -> DataFrame:
    """Keep ``low <= t < high`` (``low < t < high`` when ``low_open``) and add the bin."""
    t = F.col(time)
    above = t > low if low_open else t >= low
    return df.where(above & (t < high)).withColumn(out, time_bin(t, width))


def label_windows(df: DataFrame, out: str = "window") -> DataFrame:
    return df.withColumn(out, window_label({o: F.col(f"time_rel_{o}_onset") for o in ONSETS}))


def mean_onsets(df: DataFrame, columns: Mapping[str, str], scale: float = 1) -> DataFrame:
    """Mean onset per word less the preview, optionally scaled to ms first."""
    return df.agg(*[(F.avg(col) * scale - PREVIEW_MS).alias(out) for out, col in columns.items()])
