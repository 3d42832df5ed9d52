"""Shapes of physical plans that matter on large inputs."""

import re

import pytest
from pyspark.sql import functions as F

from gazeframe.operators import alignment, coding, exclusions, proportions, relational
from gazeframe.operators.explode import explode_parallel
from gazeframe.plans import gaze
from gazeframe.session import work_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def trials(spark):
    row = {
        "workerid": 1,
        "slide_number": 1,
        "webgazer_time": "[1, 2]",
        "unixtlist": "[1, 2]",
        "x": "[640, 10]",
        "y": "[375, 10]",
        "system_windowW": 1280,
        "system_windowH": 750,
        "target1": 1,
        "target2": 7,
        "competitor1": 2,
        "competitor2": 8,
        "condition": "all",
        "trial_type": "Exp",
        "selection_correct": 1,
    }
    folder = work_dir(spark, "plan-trials")
    spark.createDataFrame([row]).write.parquet(folder)
    return spark.read.parquet(folder)


def test_list_route_shuffles_only_partial_sums(trials):
    looks = gaze.looks_from_lists(gaze.locate(trials))
    counted = proportions.region_counts(looks, ["condition", "look"])
    assert shuffles(counted) == 1
    assert "Window" not in plan(counted) and "Join" not in plan(counted)


def test_long_route_has_no_window(trials):
    samples = explode_parallel(gaze.locate(trials), gaze.SERIES, sep=",")
    timed = alignment.with_first_sample(gaze.classify(samples))
    assert "Window" not in plan(timed)


def test_trial_filters_run_before_samples_are_made(spark, trials):
    listed = spark.createDataFrame([(9,)], "workerid bigint")
    samples = explode_parallel(trials, gaze.SERIES, sep=",")
    kept = relational.exclude(samples, listed, "workerid").where(F.col("condition") == "all")
    text = plan(kept)
    assert text.index("Generate") < text.index("LeftAnti") < text.index("FileScan")
    assert "EqualTo(condition,all)" in text


def test_accuracy_does_not_read_the_lists(trials):
    text = plan(exclusions.accuracy(trials, scored=F.col("trial_type") != "Prac"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"workerid", "trial_type", "selection_correct"}


def test_region_test_is_not_copied_into_filters(trials):
    samples = explode_parallel(gaze.locate(trials), gaze.SERIES, sep=",")
    kept = relational.with_any_look(gaze.classify(samples), ("target", "competitor"))
    assert plan(kept).count("bottomleft") == plan(gaze.classify(samples)).count("bottomleft")


def test_funnel_reads_once_and_does_not_join(trials):
    kind = F.col("trial_type")
    text = plan(exclusions.exclusion_funnel(trials, scored=kind != "Prac", wanted=kind == "Exp"))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_means_come_from_one_subquery(trials):
    out = coding.centre(trials, {"a": "workerid", "b": "slide_number", "c": "target1"})
    out.collect()
    # The other two columns reuse the subquery of the first.
    assert plan(out).split("Initial Plan")[0].count("FileScan") == 1
    assert plan(out).count("ReusedSubquery") >= 2
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
