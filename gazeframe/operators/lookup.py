"""Samples against interval and box tables.

A sample always meets one row by an equi-join: no theta join, no row per pair, no
sample id needed. ``lookup_window`` and ``lookup_box`` bring a few named entries per
key (words of an audio file, boxes of a layout) to one wide row. For any number of
entries, ``lookup_interval`` searches a key's sorted starts by halving, and
``lookup_cell`` brings boxes to the cells of a grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.aoi import first_box
from gazeframe.operators.relational import join_null_safe, settle
from gazeframe.session import stored


def lookup_window(
    samples: DataFrame,
    onsets: DataFrame,
    keys: Sequence[str],
    windows: Sequence[str],
    time: str,
    name: str = "window",
    onset: str = "onset_ms",
    before: str = "preview",
    out: str = "window",
) -> DataFrame:
    """Window whose interval ``[its onset, next onset)`` holds the sample time.

    ``onsets`` has one row per key and window, ``windows`` names them in spoken
    order. A time ahead of the first onset gets ``before``.
    """
    wide = onsets.groupBy(*keys).agg(
        *[F.min(F.when(F.col(name) == w, F.col(onset))).alias(f"_on_{w}") for w in windows]
    )
    chain = None
    for window in reversed(windows):
        reached = F.col(time) >= F.col(f"_on_{window}")
        chain = F.when(reached, window) if chain is None else chain.when(reached, window)
    joined = samples.join(wide, list(keys), "left")
    return joined.withColumn(out, chain.otherwise(before)).drop(*[f"_on_{w}" for w in windows])


def lookup_box(
    samples: DataFrame,
    boxes: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    x: str = "x",
    y: str = "y",
    out: str = "look",
) -> DataFrame:
    """First box in the order of ``names`` that strictly contains the point, else ``other``.

    ``boxes`` has columns ``box, x_min, x_max, y_min, y_max`` and one row per
    key and box.
    """
    sides = ("x_min", "x_max", "y_min", "y_max")
    wide = boxes.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("box") == name, F.struct(*sides))).alias(f"_box_{name}")
            for name in names
        ]
    )
    columns = {n: tuple(F.col(f"_box_{n}.{side}") for side in sides) for n in names}
    joined = samples.join(wide, list(keys), "left")
    return joined.withColumn(out, first_box(F.col(x), F.col(y), columns)).drop(
        *[f"_box_{name}" for name in names]
    )


def _last_not_above(starts: Column, at: Column) -> Column:
    """Place of the last of the sorted ``starts`` that is not above ``at``, -1 if there is none."""

    def halve(s: Column, _: Column) -> Column:
        half = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(starts, half) > at
        done = s["lo"] >= s["hi"]
        return F.struct(
            F.when(done | above, s["lo"]).otherwise(half + 1).alias("lo"),
            F.when(done | ~above, s["hi"]).otherwise(half).alias("hi"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))
    begin = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))
    return F.aggregate(steps, begin, halve)["lo"] - 1


def lookup_interval(
    samples: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    name: str,
    end: str | None = None,
    out: str = "interval",
) -> DataFrame:
    """Add the ``name`` of the interval that holds each sample's time, NULL if none does.

    ``intervals`` has any number of rows per key. An interval begins at ``start`` and lasts to the next start of
    its key, or before ``end`` if that is named and not NULL. Of intervals with one start the largest name counts.
    A NULL key is a key; intervals without start are left out; a sample without time is in none. A key's starts
    are gathered in one sorted row, and a sample looks at as many of them as its number has binary digits.
    """
    entry = F.struct(
        F.col(start).alias("s"), F.col(name).alias("n"), (F.col(end) if end else F.lit(None).cast("double")).alias("e")
    )
    gathered = (
        intervals.where(F.col(start).isNotNull())
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(*keys, "_entries", F.col("_entries.s").alias("_starts"))
    )
    joined = join_null_safe(samples, gathered, keys, "left")
    placed = settle(joined, {"_at": _last_not_above(F.col("_starts"), F.col(time))})
    found = F.when(F.col("_at") >= 0, F.get("_entries", F.col("_at")))
    inside = found["e"].isNull() | (F.col(time) < found["e"])
    return placed.withColumn(out, F.when(F.col(time).isNotNull() & inside, found["n"])).drop("_at", "_entries", "_starts")


def lookup_cell(
    samples: DataFrame,
    boxes: DataFrame,
    keys: Sequence[str],
    cell: float,
    x: str = "x",
    y: str = "y",
    name: str = "box",
    order: str = "box",
    out: str = "look",
    most_cells: int = 1024,
    most_near: int = 16,
) -> DataFrame:
    """Add the ``name`` of the first box by ``order`` that strictly contains each point, NULL if none does.

    ``boxes`` has x_min, x_max, y_min and y_max and any number of rows per key. Boxes are brought to the cells of
    a grid with sides of ``cell``, best about the size of a common box, and a point is held against the boxes of
    its own cell. A box over more than ``most_cells`` cells is brought only to the cells where points of its key
    lie, for which ``samples`` is read twice. Of a cell's boxes, those behind the first that covers the whole cell
    are left out, as no point of the cell meets one of them first. A cell that still has more than ``most_near``
    boxes is cut into 16, up to three times; so where boxes lie over each other a point is held against few. The
    cells are written to the shared folder. A NULL key is a key; boxes without a side and points without a place
    meet nothing.
    """
    sides = ("x_min", "x_max", "y_min", "y_max")
    cell_keys = [*keys, "_cx", "_cy"]

    def at(column: Column, level: int) -> Column:
        return F.floor(column / (cell / 4**level)).cast("long")

    def bounds(level: int) -> dict[str, Column]:
        return {f"_{side}": at(F.col(f"_box.{side}"), level) for side in sides}

    def ahead(met: DataFrame) -> DataFrame:
        """Boxes of cells up to the first that covers its cell: a point of a later cell lies above a bound."""
        across = (F.col("_x_min") < F.col("_cx")) & (F.col("_cx") < F.col("_x_max"))
        down = (F.col("_y_min") < F.col("_cy")) & (F.col("_cy") < F.col("_y_max"))
        covered = met.where(across & down).groupBy(*cell_keys).agg(F.min("_box").alias("_least"))
        kept = join_null_safe(met, covered, cell_keys, "left").where("_least IS NULL OR _box <= _least")
        return stored(kept.select(*cell_keys, "_box"), "cells")

    x_low, x_high, y_low, y_high = (at(F.col(side), 0).cast("double") for side in sides)
    spans = (x_high - x_low + 1) * (y_high - y_low + 1)
    entry = F.struct(F.col(order).alias("o"), F.col(name).alias("n"), *sides)
    whole = boxes.where("x_min < x_max AND y_min < y_max").select(*keys, entry.alias("_box"), spans.alias("_cells"))
    whole = whole.withColumns(bounds(0))
    small = whole.where(F.col("_cells") <= most_cells).drop("_cells")
    small = small.withColumn("_cx", F.explode(F.sequence("_x_min", "_x_max")))
    small = small.withColumn("_cy", F.explode(F.sequence("_y_min", "_y_max")))
    placed = samples.withColumns({"_cx": at(F.col(x), 0), "_cy": at(F.col(y), 0), "_level": F.lit(0)})
    looked_at = placed.where("_cx IS NOT NULL AND _cy IS NOT NULL").select(*cell_keys).distinct()
    wide = join_null_safe(looked_at, whole.where(F.col("_cells") > most_cells).drop("_cells"), keys).where(
        "_cx BETWEEN _x_min AND _x_max AND _cy BETWEEN _y_min AND _y_max"
    )
    entries = ahead(small.unionByName(wide))
    cells = None
    for level in range(4):
        counted = entries.groupBy(*cell_keys).agg(F.count("*").alias("_n"))
        # Far from the origin four times a cell's number would not be a long.
        dense = counted.where(F.col("_n") > most_near).where("abs(_cx + 0D) < 1e15 AND abs(_cy + 0D) < 1e15")
        last = level == 3 or (dense := stored(dense.select(*cell_keys, F.lit(True).alias("_cut")), "dense")).isEmpty()
        listed = entries if last else join_null_safe(entries, dense, cell_keys, "left").where("_cut IS NULL")
        near = listed.groupBy(*cell_keys).agg(F.array_sort(F.collect_list("_box")).alias("_near"))
        near = near.withColumn("_level", F.lit(level))
        cells = near if cells is None else cells.unionByName(near)
        if last:
            break
        cut = join_null_safe(entries, dense, cell_keys).withColumns(bounds(level + 1))
        for c, low, high in (("_cx", "_x_min", "_x_max"), ("_cy", "_y_min", "_y_max")):
            first, end = F.greatest(F.col(low), F.col(c) * 4), F.least(F.col(high), F.col(c) * 4 + 3)
            cut = cut.withColumn(c, F.explode(F.sequence(first, end)))
        entries = ahead(cut.drop("_cut"))
        finer = {"_cx": at(F.col(x), level + 1), "_cy": at(F.col(y), level + 1), "_level": F.lit(level + 1)}
        here = join_null_safe(placed, dense.withColumn("_level", F.lit(level)), [*cell_keys, "_level"], "left")
        placed = here.withColumns({c: F.when(F.col("_cut"), v).otherwise(F.col(c)) for c, v in finer.items()}).drop("_cut")

    def holds(b: Column) -> Column:
        px, py = F.col(x), F.col(y)
        return (px > b["x_min"]) & (px < b["x_max"]) & (py > b["y_min"]) & (py < b["y_max"])

    met = join_null_safe(placed, cells, [*cell_keys, "_level"], "left")
    hit = settle(met, {"_hit": F.get(F.filter("_near", holds), F.lit(0))})
    return hit.withColumn(out, F.col("_hit.n")).drop("_cx", "_cy", "_level", "_near", "_hit")
