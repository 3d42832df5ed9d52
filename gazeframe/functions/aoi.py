"""Areas of interest: rectangles, looks and roles."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeframe.functions.nulls import flag

# A display pairs a picture AOI with the figure AOI beside it.
QUADRANT_OF_PAIR = {
    (1, 7): "topleft",
    (2, 8): "bottomleft",
    (3, 9): "topright",
    (4, 10): "bottomright",
}

CORNERS = ("topleft", "bottomleft", "topright", "bottomright")
ROLES = ("target", "competitor", "center", "other")


def quadrant(picture: Column, figure: Column) -> Column:
    """AOI number pair to quadrant name, NULL for any other pair."""
    out = F.lit(None).cast("string")
    for (first, second), name in QUADRANT_OF_PAIR.items():
        out = F.when((picture == first) & (figure == second), name).otherwise(out)
    return out


@dataclass(frozen=True)
class Layout:
    """Screen layout in pixels, centred in the browser window.

    ``y_down`` says that y grows downwards, as browsers report it, so the top
    boxes have small y. ``y_down=False`` puts the top boxes at large y.
    """

    # The main study's layout.
    scene_width: int = 1280
    scene_height: int = 750
    corner_width: int = 217
    corner_height: int = 250
    inner_width_padding: int = 60
    outer_width_padding: int = 0
    height_padding: int = 0
    center_width: int = 220
    center_height: int = 110
    y_down: bool = True

    def boxes(self, window_w: Column, window_h: Column) -> dict[str, tuple[Column, ...]]:
        """``name -> (x_min, x_max, y_min, y_max)``, in the order looks are tested."""
        mid_x, mid_y = window_w / 2, window_h / 2
        half_w, half_h = self.scene_width / 2, self.scene_height / 2
        reach_x = self.corner_width + self.inner_width_padding
        reach_y = self.corner_height + self.height_padding
        columns = {
            "left": (mid_x - half_w - self.outer_width_padding, mid_x - half_w + reach_x),
            "right": (mid_x + half_w - reach_x, mid_x + half_w + self.outer_width_padding),
        }
        low_band = (mid_y - half_h, mid_y - half_h + reach_y)
        high_band = (mid_y + half_h - reach_y, mid_y + half_h)
        rows = {"top": low_band, "bottom": high_band}
        if not self.y_down:
            rows = {"top": high_band, "bottom": low_band}
        out = {}
        for corner in CORNERS:
            side = "left" if corner.endswith("left") else "right"
            out[corner] = columns[side] + rows[corner.removesuffix(side)]
        out["center"] = (
            mid_x - self.center_width / 2,
            mid_x + self.center_width / 2,
            mid_y - self.center_height / 2,
            mid_y + self.center_height / 2,
        )
        return out

    def look(self, x: Column, y: Column, window_w: Column, window_h: Column) -> Column:
        return first_box(x, y, self.boxes(window_w, window_h))


# Paddings of the earlier snapshot and of the second pilot.
SNAPSHOT_LAYOUT = Layout(
    corner_width=257, corner_height=220, inner_width_padding=0, center_width=260, center_height=130
)
PILOT_LAYOUT = Layout(
    corner_width=237, corner_height=220, inner_width_padding=0, center_width=240, center_height=130
)


def first_box(x: Column, y: Column, boxes: Mapping[str, tuple[Column, ...]]) -> Column:
    """Name of the first box that strictly contains the point, else ``other``."""
    chain = None
    for name, (x_min, x_max, y_min, y_max) in boxes.items():
        inside = (x > x_min) & (x < x_max) & (y > y_min) & (y < y_max)
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain.otherwise("other")


def role(look: Column, target_location: Column, competitor_location: Column) -> Column:
    return (
        F.when(look == target_location, "target")
        .when(look == competitor_location, "competitor")
        .when(look == "center", "center")
        .otherwise("other")
    )


def role_flags(roi: Column, swap: bool = False) -> dict[str, Column]:
    """``<role>_look`` 0/1 columns; ``swap`` exchanges target and competitor.

    ``swap=True`` goes with ``Layout(y_down=False)``: the flipped boxes exchange
    the two quadrants of a column, which always hold target and competitor.
    """
    source = {name: name for name in ROLES}
    if swap:
        source.update(target="competitor", competitor="target")
    return {f"{name}_look": flag(roi == source[name]) for name in ROLES}


def in_range(x: Column, y: Column, x_low, x_high, y_low, y_high) -> Column:
    """Strict spatial outlier bounds."""
    return (x > x_low) & (x < x_high) & (y > y_low) & (y < y_high)


# X and y outlier bounds of the main study and the wider earlier ones.
MAIN_RANGE = (-1000, 2280, -1000, 1750)
WIDE_RANGE = (-2000, 3000, -2000, 2000)
