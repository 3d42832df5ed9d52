"""Lookups in any number of intervals and boxes against plain loops."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from gazeframe.functions import text
from gazeframe.operators import lookup
from gazeframe.operators.explode import explode_parallel
from gazeframe.sources import files, submissions


def test_a_key_with_thousands_of_intervals(spark):
    rng = random.Random(1)
    starts = {"a": sorted(rng.sample(range(100_000), 5000)), "b": [7], None: [0, 50]}
    intervals = [(k, float(s), f"{k}{s}", float(s + 9) if k == "a" and s % 2 else None) for k, v in starts.items() for s in v]
    samples = [(i, rng.choice(["a", "a", "b", "c", None]), float(rng.randrange(-5, 100_100))) for i in range(3000)]
    samples += [(9001, "a", None), (9002, "a", float(starts["a"][17])), (9003, None, 49.0), (9004, None, 50.0)]
    made = lookup.lookup_interval(
        spark.createDataFrame(samples, "id int, k string, t double"),
        spark.createDataFrame(intervals, "k string, s double, n string, e double").repartition(5),
        ["k"], "t", "s", "n", "e",
    )
    ends = {(k, s): e for k, s, _, e in intervals}
    want = {}
    for i, k, t in samples:
        at = bisect_right(starts.get(k, []), t) - 1 if t is not None else -1
        start = starts[k][at] if at >= 0 else None
        end = ends.get((k, start))
        want[i] = f"{k}{start}" if at >= 0 and (end is None or t < end) else None
    assert {r.id: r.interval for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_equal_starts_and_missing_starts(spark):
    intervals = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, None, "z")], "k int, s int, n string")
    samples = spark.createDataFrame([(1, 4), (1, 5), (2, 5)], "k int, t int")
    found = lookup.lookup_interval(samples, intervals, ["k"], "t", "s", "n").collect()
    assert sorted((r.k, r.t, r.interval or "") for r in found) == [(1, 4, ""), (1, 5, "y"), (2, 5, "")]


def test_boxes_in_grid_cells(spark):
    """Small, wide, overlapping and empty boxes; points on an edge are outside."""
    rng = random.Random(2)
    boxes = []
    for i in range(400):
        x, y, w = rng.randrange(-500, 2000), rng.randrange(-500, 1500), rng.choice([3, 64, 300, 50_000])
        boxes.append((rng.choice([1, None]), i, float(x), float(x + w), float(y), float(y + w)))
    boxes += [(1, 900, 5.0, 5.0, 0.0, 9.0), (1, 901, None, 9.0, 0.0, 9.0)]
    points = [(i, rng.choice([1, 2, None]), float(rng.randrange(-600, 2100)), float(rng.randrange(-600, 1600))) for i in range(1500)]
    points += [(5000, 1, None, 1.0), (5001, 1, boxes[0][2], boxes[0][4])]
    made = lookup.lookup_cell(
        spark.createDataFrame(points, "id int, k int, x double, y double"),
        spark.createDataFrame(boxes, "k int, box int, x_min double, x_max double, y_min double, y_max double"),
        ["k"], cell=50, most_cells=100,
    )
    want = {}
    for i, k, x, y in points:
        hits = [b for q, b, x0, x1, y0, y1 in boxes if q == k and x is not None and x0 is not None and x0 < x < x1 and y0 < y < y1]
        want[i] = min(hits, default=None)
    assert {r.id: r.look for r in made.collect()} == want
    assert made.columns == ["id", "k", "x", "y", "look"]


def test_boxes_piled_over_each_other(spark, monkeypatch):
    """A point meets few boxes however many lie over its cell: those behind one that covers the cell are left out."""
    rng = random.Random(3)
    boxes = []
    for i in range(3000):
        x, y, w = rng.randrange(-80, 120), rng.randrange(-80, 120), rng.choice([5.0, 30.0, 64.0, 7000.0])
        boxes.append((rng.choice([1, None]), rng.randrange(2500), float(x), x + w, float(y), y + w))
    boxes += [(2, 5, 0.0, 0.5, 0.0, 0.5), (2, 6, float("-inf"), float("inf"), 1.0, 2.0)]
    points = [(i, rng.choice([1, None, None]), rng.randrange(-400, 600) / 4, rng.randrange(-400, 600) / 4) for i in range(2000)]
    points += [(5000, 2, -1e300, 1.5), (5001, 2, 64.0, 2.0), (5002, 2, 0.25, 0.25), (5003, 2, None, 1.5)]
    frames, stored = [], lookup.stored
    monkeypatch.setattr(lookup, "stored", lambda df, purpose: frames.append((purpose, stored(df, purpose))) or frames[-1][1])
    made = lookup.lookup_cell(
        spark.createDataFrame(points, "id int, k int, x double, y double"),
        spark.createDataFrame(boxes, "k int, box int, x_min double, x_max double, y_min double, y_max double"),
        ["k"], cell=32, most_cells=100, most_near=8,
    )
    got = {r.id: r.look for r in made.collect()}
    for i, k, x, y in points:
        hits = [b for q, b, x0, x1, y0, y1 in boxes if q == k and x is not None and x0 < x < x1 and y0 < y < y1]
        assert got[i] == min(hits, default=None)
    levels = [df for purpose, df in frames if purpose == "cells"]
    most = [df.groupBy("k", "_cx", "_cy").count().agg(F.max("count")).first()[0] for df in levels]
    assert len(levels) > 1 and most[-1] < most[0] < 700


def test_lists_of_several_brackets_and_fractions(spark):
    df = spark.createDataFrame([("[1, 2], [3, 4]", "[1, 2.5, 3, x]", "[]", None)], "a string, b string, c string, d string")
    out = df.select(*[text.parse_list(F.col(c), "bigint").alias(c) for c in "abcd"], text.parse_list(F.col("b"), "double").alias("e")).first()
    assert tuple(out) == ([1, 2, 3, 4], [1, 2, 3, None], [], None, [1.0, 2.5, 3.0, None])
    rows = explode_parallel(df.select("a", F.col("b").alias("n")), {"a": "bigint", "n": "double"}, sep=",").collect()
    assert [tuple(r) for r in rows] == [(1, 1.0), (2, 2.5), (3, 3.0), (4, None)]


def test_submission_fields_that_trials_have_too(spark):
    schema = "trials array<struct<slide: bigint, condition: string>>, condition string"
    df = spark.createDataFrame([('{"trials": [{"slide": 1, "condition": "own"}], "condition": "whole"}',)], "json string")
    flat = submissions.flatten_submissions(submissions.parse_submissions(df, "json", schema))
    assert flat.columns == ["submission_condition", "slide", "condition"]
    assert flat.select("condition", "submission_condition").first() == ("own", "whole")


def test_csv_lines_with_quotes_and_header(spark):
    df = spark.createDataFrame([('a,"b"', 1), ("two\nlines", None), ("", 2)], "s string, n int")
    lines = [r.line for r in files.csv_lines(df.coalesce(1), header=True).collect()]
    assert lines == ["s,n", '"a,""b""",1', '"two\nlines",NA', ",2"]
