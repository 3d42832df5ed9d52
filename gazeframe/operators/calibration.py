"""Calibration accuracy of the gaze predictor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: predictions one calibration score is taken over.
POINTS = 50


def point_precision(x: Column, y: Column, window_w: Column, window_h: Column) -> Column:
    """100 at the window centre, falling to 0 at half a window height away."""
    dx, dy = window_w / 2 - x, window_h / 2 - y
    half = window_h / 2
    return F.greatest(F.lit(0.0), 100 - F.sqrt(dx * dx + dy * dy) / half * 100)


def calibration_accuracy(
    points: DataFrame, keys: Sequence[str] = ("workerid",), point_no: str = "point_no"
) -> DataFrame:
    """Mean precision of the first points per worker, rounded half up."""
    precision = point_precision(F.col("x"), F.col("y"), F.col("windowW"), F.col("windowH"))
    total = F.sum(precision) / POINTS
    return (
        points.where(F.col(point_no) < POINTS)
        .groupBy(*keys)
        .agg(F.floor(total + 0.5).cast("int").alias("accuracy"))
    )
