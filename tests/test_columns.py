"""NULL rules, text, boxes, times and scores on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from gazeframe.functions import aoi, scores, text, timebins
from gazeframe.functions.nulls import flag, indicator, one_of_two, r_ifelse, r_round
from gazeframe.functions.tdist import two_sided_p


def values(df, *cols):
    rows = [tuple(row) for row in df.select(*cols).collect()]
    return [row[0] for row in rows] if len(cols) == 1 else rows


def test_ifelse_keeps_null_and_flag_does_not(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    test = F.col("a") == 1
    assert values(df, r_ifelse(test, "y", "n")) == ["y", "n", None]
    assert values(df, indicator(test)) == [1, 0, None]
    assert values(df, flag(test)) == [1, 0, 0]


@pytest.mark.parametrize(
    "response, first, second, want",
    [("1", "1", None, 1), ("3", "1", None, None), ("3", "1", "7", 0), ("7", "1", "7", 1), (None, "1", "7", None)],
)
def test_selection_correct(spark, response, first, second, want):
    df = spark.createDataFrame([(response, first, second)], "r string, a string, b string")
    assert values(df, one_of_two(F.col("r"), F.col("a"), F.col("b"))) == [want]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert values(df, r_round(F.col("v"))) == [0.0, 2.0, 2.0]


def test_list_text(spark):
    df = spark.createDataFrame([("['AOI1', 'AOI7', 'AOI1']", "[1.5, 2,x]", "[]")], "r string, l string, e string")
    assert values(df, text.strip_list_text(F.col("r"))) == ["1,7,1"]
    parts = text.split_fixed(text.strip_list_text(F.col("r")), ("a", "b", "c", "d"))
    assert values(df, *parts) == [("1", "7", "1", None)]
    assert values(df, text.parse_list(F.col("l"), "double")) == [[1.5, 2.0, None]]
    assert values(df, text.parse_list(F.col("e"), "double")) == [[]]


def test_words(spark):
    words = "Click on the boy that has two of Susan's pears"
    df = spark.createDataFrame([(words, "Mean_target_look")], "i string, n string")
    assert values(df, text.last_word(F.col("i"))) == ["pears"]
    assert values(df, text.name_part(F.col("n"), 2)) == ["target"]
    steps = df.select(F.inline(text.incremental_prefixes(F.col("i")))).collect()
    assert [row.shown for row in steps] == [
        "Click on the ...",
        "Click on the boy that has ...",
        "Click on the boy that has two of Susan's ...",
        words + ".",
    ]


def test_quadrants(spark):
    pairs = [(1, 7), (2, 8), (3, 9), (4, 10), (1, 8), (None, 7)]
    df = spark.createDataFrame(pairs, "p int, f int")
    assert values(df, aoi.quadrant(F.col("p"), F.col("f"))) == [
        "topleft",
        "bottomleft",
        "topright",
        "bottomright",
        None,
        None,
    ]


def points(spark):
    step = [(float(x), float(y)) for x in range(-5, 1290, 37) for y in range(-5, 760, 29)]
    edges = [(0.0, 100.0), (277.0, 100.0), (100.0, 250.0), (None, 3.0), (640.0, 375.0), (10.0, 10.0), (10.0, 740.0)]
    return spark.createDataFrame(step + edges, "x double, y double").withColumns(
        {"w": F.lit(1280), "h": F.lit(750)}
    )


def test_box_edges_are_outside(spark):
    df = points(spark)
    look = aoi.Layout().look(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    seen = {(row.x, row.y): row.look for row in df.withColumn("look", look).collect()}
    assert seen[(0.0, 100.0)] == seen[(277.0, 100.0)] == seen[(100.0, 250.0)] == "other"
    assert seen[(None, 3.0)] == "other"
    assert seen[(640.0, 375.0)] == "center"
    assert seen[(10.0, 10.0)] == "topleft"
    assert seen[(10.0, 740.0)] == "bottomleft"


def test_flipped_boxes_with_swapped_roles_agree(spark):
    df = points(spark).withColumns({"t": F.lit("topleft"), "c": F.lit("bottomleft")})
    columns = []
    for layout, swap in ((aoi.Layout(), False), (aoi.Layout(y_down=False), True)):
        look = layout.look(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
        flags = aoi.role_flags(aoi.role(look, F.col("t"), F.col("c")), swap)
        columns.append(F.concat_ws("", *flags.values()))
    same = values(df, columns[0], columns[1])
    assert all(a == b for a, b in same)
    assert {"1000", "0100", "0010", "0001"} == {a for a, _ in same}


def test_uneven_padding_breaks_the_equality(spark):
    df = points(spark).withColumns({"t": F.lit("topleft"), "c": F.lit("bottomleft")})
    tall = aoi.Layout(corner_height=300, center_height=200, center_width=900)
    look = tall.look(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    # First match wins where boxes overlap.
    overlap = df.where("x = 254 and y = 285").select(look.alias("look")).first()
    assert overlap is not None and overlap.look == "topleft"


def test_time_bins_and_bounds(spark):
    df = spark.createDataFrame([(0.0,), (99.99,), (100.0,), (3999.9,), (4000.0,), (-0.5,)], "t double")
    from gazeframe.operators.alignment import bin_time

    kept = bin_time(df, "t")
    assert values(kept, "binned_time_relative") == [0, 0, 100, 3900]


def test_window_labels(spark):
    rows = [(-1, -2, -3, -4, -5), (0, -1, -2, -3, -4), (1, 0, -1, -2, -3), (2, 1, 0, -1, -2), (3, 2, 1, 0, -1), (4, 3, 2, 1, 0)]
    names = timebins.ONSETS
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    label = timebins.window_label({n: F.col(n) for n in names})
    assert values(df, label) == list(timebins.WINDOWS)


def test_sample_times_and_halves(spark):
    df = spark.createDataFrame([(100, 30), (0, 31)], "s int, n int")
    assert values(df, F.round(timebins.sample_to_ms(F.col("s")), 6)) == [590.0, -1000.0]
    assert values(df, timebins.half(F.col("n"))) == ["first_half", "second_half"]


def test_log_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.5, 0.5)], "p double, q double")
    s = 1e-8
    forward = values(df, scores.log_ratio(F.col("p"), F.col("q")))
    assert forward == pytest.approx([math.log((1 + s) / s), 0.0])
    assert values(df, scores.log_ratio(F.col("p"), F.col("q"), reverse=True)) == pytest.approx([-v for v in forward])
    outer = [math.log(1 / s + s), math.log(0.5 / (0.5 + s) + s)]
    assert values(df, scores.log_ratio_outer(F.col("p"), F.col("q"))) == pytest.approx(outer)


def test_p_classes(spark):
    found = [0.00001, 0.0005, 0.005, 0.05, 0.12345, 0.5, 1.0, None]
    df = spark.createDataFrame([(p,) for p in found], "p double")
    assert values(df, scores.p_class(F.col("p"))) == ["<.0001", "<.001", "<.01", "<.05", ">0.12", ">0.5", ">1", None]


def test_category_order_and_recode(spark):
    df = spark.createDataFrame([("some",), ("two",), (None,)], "c string")
    assert values(df, scores.level_order(F.col("c"), ("all", "some"))) == [2, None, None]
    assert values(df, scores.recode(F.col("c"), {"two": "number"})) == ["some", "number", None]


@pytest.mark.parametrize(
    "t, dof, p",
    # Published table values: two-sided 5% and 1% points, Cauchy and normal limits.
    [(2.228139, 10, 0.05), (2.750, 30, 0.01), (1.0, 1, 0.5), (1.959964, 1e7, 0.05), (0.0, 5, 1.0)],
)
def test_student_p_values(t, dof, p):
    assert two_sided_p(t, dof) == pytest.approx(p, abs=2e-5)
    assert two_sided_p(-t, dof) == pytest.approx(p, abs=2e-5)
