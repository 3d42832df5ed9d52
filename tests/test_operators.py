"""Operators against brute force on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gazeframe.operators import (
    alignment,
    bootstrap,
    calibration,
    coding,
    correlation,
    exclusions,
    lookup,
    proportions,
    ranking,
    regression,
    relational,
    reshape,
    sessions,
    stats,
)
from gazeframe.operators.explode import explode_parallel
from gazeframe.plans import gaze


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_parallel_lists(spark):
    df = spark.createDataFrame([(1, "[1.0, 2.5]", "[10,20]"), (2, "[]", "[]")], "id int, t string, u string")
    out = explode_parallel(df, {"t": "double", "u": "bigint"}, sep=",", position="i")
    assert rows(out) == [(1, 0, 1.0, 10), (1, 1, 2.5, 20)]


def test_uneven_lists_are_an_error(spark):
    df = spark.createDataFrame([("[1, 2, 3]", "[1, 2]")], "t string, u string")
    with pytest.raises(PySparkException, match="differ in length"):
        explode_parallel(df, {"t": "double", "u": "double"}, sep=",").collect()


def test_null_in_exclusion_list_has_no_effect(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "workerid int")
    listed = spark.createDataFrame([(2,), (None,)], "workerid int")
    assert rows(relational.exclude(df, listed, "workerid")) == [(1,), (3,)]


def test_any_look_drops_null_flags(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (None, 1), (None, 0)], "target_look int, center_look int")
    assert relational.with_any_look(df, ("target", "center")).count() == 2


def hot_rows(n=3000, seed=3):
    """A third of the rows belong to worker 0."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 1 / 3 else rng.randrange(1, 40), i * 7 % n, i) for i in range(n)]


@pytest.mark.parametrize("parts", [None, 1, 40])
def test_numbers_within_hot_workers(spark, parts):
    data = hot_rows()
    df = spark.createDataFrame(data, "w int, o int, id int").repartition(5)
    got = {row.id: row.trial_number for row in ranking.number_within(df, ["w"], ["o"], parts=parts).collect()}
    seen, want = Counter(), {}
    for w, _, i in sorted(data):
        seen[w] += 1
        want[i] = seen[w]
    assert got == want


def test_numbers_with_null_key_and_order(spark):
    data = [(None, 5), (None, 2), (None, None), (1, None), (1, 9), (1, 3)]
    df = spark.createDataFrame(data, "w int, o int")
    want = rows(spark.createDataFrame([(-1, -1, 1), (-1, 2, 2), (-1, 5, 3), (1, -1, 1), (1, 3, 2), (1, 9, 3)]))
    for parts in (None, 1, 6):
        assert rows(ranking.number_within(df, ["w"], ["o"], parts=parts).na.fill(-1)) == want


def test_seeded_order_is_a_permutation(spark):
    df = spark.createDataFrame([(w, i) for w in range(3) for i in range(20)], "w int, i int")
    first = ranking.seeded_order(df, "w", "i", "a").collect()
    again = ranking.seeded_order(df.repartition(7), "w", "i", "a", parts=20).collect()
    other = ranking.seeded_order(df, "w", "i", "b").collect()
    order = lambda found: sorted((r.w, r.presentation, r.i) for r in found)
    assert order(first) == order(again)
    assert order(first) != order(other)
    assert sorted(r.presentation for r in first if r.w == 1) == list(range(1, 21))


@pytest.mark.parametrize("parts", [None, 1, 50])
def test_quantiles(spark, parts):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501), "b": np.array([4.0]), "c": rng.integers(0, 5, 400).astype(float)}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = (0, 0.025, 0.25, 0.5, 0.75, 1)
    got = {r.g: r.quantiles for r in stats.quantiles(df, ["g"], "v", probs, parts=parts).collect()}
    for key, found in groups.items():
        assert got[key] == pytest.approx(np.quantile(found, probs).tolist())
    whole = stats.quantiles(df, [], "v", probs, parts=parts).first()[0]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(groups.values())), probs).tolist())


def test_counts_shares_and_tables(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "g string, h string")
    assert rows(stats.counts(df, "g")) == [("a", 2), ("b", 1)]
    assert sum(r.share for r in stats.shares(df, "g").collect()) == pytest.approx(1)
    assert rows(stats.cross_table(df, "g", "h", ["x", "y"])) == [("a", 1, 1), ("b", 1, 0)]
    assert stats.distinct_combinations(df, "g", "h").first()[0] == 4


def choice_log():
    """Three workers of 4 scored trials and one practice trial; worker 2 misses half."""
    data = []
    for worker, hits in ((1, 4), (2, 2), (3, 3)):
        for i in range(4):
            data.append((worker, "Exp" if i < 3 else "Filler", int(i < hits)))
        data.append((worker, "Prac", None))
    return data + [(4, "Prac", 1)]


def test_exclusion_funnel(spark):
    df = spark.createDataFrame(choice_log(), "workerid int, kind string, selection_correct int")
    scored, wanted = F.col("kind") != "Prac", F.col("kind") == "Exp"
    found = exclusions.exclusion_funnel(df, scored, wanted, least=0.75, divisor=4).orderBy("stage_no").collect()
    # Worker 4 has no scored trial, hence no rate, and stays.
    assert [(r.rows_left, r.workers_left) for r in found] == [(16, 4), (11, 3), (8, 3), (6, 2)]
    assert [r.rows_left for r in found] == sorted((r.rows_left for r in found), reverse=True)
    kept = exclusions.apply_exclusions(df, scored, wanted, least=0.75, divisor=4)
    assert kept.count() == 6 and {r.workerid for r in kept.collect()} == {1, 3}


def test_accuracy_ignores_null_and_can_pass_one(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (2, None)], "workerid int, selection_correct int")
    assert rows(exclusions.accuracy(df, divisor=1)) == [(1, 2, 2.0), (2, 0, 0.0)]


def looks(spark):
    rng = random.Random(5)
    data = []
    for _ in range(2000):
        region = rng.choice(("target", "competitor", "center", "other"))
        data.append((rng.choice("ab"), rng.randrange(9), *[int(region == r) for r in ("target", "competitor", "center")]))
    return spark.createDataFrame(data, "condition string, bin int, target_look int, competitor_look int, center_look int")


def test_proportions_of_a_closed_set_sum_to_one(spark):
    regions = proportions.REGIONS
    found = proportions.look_proportions(looks(spark), ["condition", "bin"], regions, regions).collect()
    assert len(found) == 18
    for row in found:
        assert row.target_prop + row.competitor_prop + row.center_prop == pytest.approx(1)
    every = proportions.look_proportions(looks(spark), ["condition", "bin"], regions).collect()
    assert any(row.target_prop + row.competitor_prop + row.center_prop < 1 for row in every)


def test_proportions_by_sets_equal_single_runs(spark):
    df, sets = looks(spark), [["condition"], ["bin"], ["condition", "bin"]]
    both = proportions.proportions_by_sets(df, sets, require=("target", "competitor"))
    for keys in sets:
        one = proportions.look_proportions(df, keys, require=("target", "competitor"))
        some = both.where(F.col("key_set") == ",".join(keys)).select(*one.columns)
        assert rows(some) == rows(one)


def test_unknown_flags_are_left_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 0), ("b", None)], "g string, target_look int")
    got = {r.g: r for r in proportions.look_proportions(df, ["g"], ("target",)).collect()}
    assert (got["a"].n, got["a"].n_target, got["a"].target_prop) == (3, 2, 0.5)
    assert got["b"].target_prop is None


def test_melted_measures(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1, 0.2, 0.3)], "id int, a_prop double, a_low double, b_prop double, b_low double")
    out = reshape.melt_measures(df, ["id"], ("a", "b"), {"p": "{}_prop", "low": "{}_low"}, "g")
    assert rows(out) == [(1, "a", 0.5, 0.1), (1, "b", 0.2, 0.3)]


def test_binomial_interval_matches_standard_error(spark):
    df = spark.createDataFrame([("x", 400, 100), ("y", 400, 400), ("z", 25, 5)], "g string, n int, k int")
    got = {r.g: r for r in bootstrap.binomial_intervals(df, ["g"], {"t": ("k", "n")}).collect()}
    error = 1.96 * (0.25 * 0.75 / 400) ** 0.5
    assert got["x"].t_CILow == pytest.approx(error, rel=0.15)
    assert got["x"].t_CIHigh == pytest.approx(error, rel=0.15)
    assert got["y"].t_CILow == got["y"].t_CIHigh == 0
    assert got["z"].t_CILow > got["x"].t_CILow
    again = bootstrap.binomial_intervals(df.repartition(3), ["g"], {"t": ("k", "n")})
    assert rows(again) == rows(bootstrap.binomial_intervals(df, ["g"], {"t": ("k", "n")}))


def test_limits_of_binomial_intervals(spark):
    """The bounds are the quantiles of the law that resampled means follow, at any size."""
    from math import comb

    for n, k in ((1, 1), (5, 0), (7, 3), (60, 59), (400, 100)):
        p = k / n
        law = np.cumsum([comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
        want = [int(np.argmax(law >= t - 1e-12)) for t in bootstrap.TAILS]
        assert bootstrap.binomial_quantiles(n, k).tolist() == want
    far = bootstrap.binomial_quantiles(10**9, 250_000_000)
    assert (250_000_000 - far[0]) / (0.25 * 0.75 * 10**9) ** 0.5 == pytest.approx(1.96, rel=1e-3)
    df = spark.createDataFrame([("x", 100, 400), ("z", None, 3), ("w", 0, 0)], "g string, k bigint, n bigint")
    got = {r.g: r for r in bootstrap.binomial_intervals(df, ["g"], {"t": ("k", "n")}, resamples=None).collect()}
    drawn = {r.g: r for r in bootstrap.binomial_intervals(df, ["g"], {"t": ("k", "n")}, resamples=20_000).collect()}
    assert got["x"].t_CILow == pytest.approx(drawn["x"].t_CILow, abs=0.004)
    assert got["z"].t_CILow is None and got["w"].t_CIHigh is None


@pytest.mark.parametrize("size", [4096, 10])
def test_bootstrap_of_means(spark, size):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(3, 2, 600), "b": np.full(50, 7.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r for r in bootstrap.bootstrap_mean(df, ["g"], "v", part_values=size).collect()}
    a = groups["a"]
    error = 1.96 * a.std(ddof=1) / len(a) ** 0.5
    assert (got["a"].mean, got["a"].n) == (pytest.approx(a.mean()), 600)
    assert got["a"].CILow == pytest.approx(error, rel=0.15)
    assert got["a"].CIHigh == pytest.approx(error, rel=0.15)
    assert got["b"].CILow == pytest.approx(0, abs=1e-12) and got["b"].CIHigh == pytest.approx(0, abs=1e-12)


def test_first_samples_and_alignment(spark):
    data = [(1, 1, 50.0, 1050), (1, 1, 1250.0, 2250), (1, 2, 9.0, 9), (1, 2, 2009.0, 2009)]
    df = spark.createDataFrame(data, "workerid int, slide_number int, webgazer_time double, unixtlist bigint")
    df = df.withColumns({"click_onset_ms": F.lit(100.0), "click_onset_ms_200shift": F.lit(300.0)})
    timed = alignment.with_first_sample(df)
    plain = alignment.align(timed, onsets=("click",))
    assert sorted(r.time_rel_click_onset for r in plain.collect()) == [-1100.0, -1100.0, 100.0, 900.0]
    shifted = alignment.align(timed, shift=200, onsets=("click",))
    assert sorted(r.time_rel_click_onset for r in shifted.collect()) == [-1300.0, -1300.0, -100.0, 700.0]


def gaze_trial(spark):
    trial = {
        "workerid": 1,
        "slide_number": 3,
        "webgazer_time": "[5, 10, 20, 1300]",
        "unixtlist": "[1005, 1010, 1020, 2300]",
        "x": "[640, 500, 640, 10]",
        "y": "[375, 300, 375, 10]",
        "system_windowW": 1280,
        "system_windowH": 750,
        "target1": 1,
        "target2": 7,
        "competitor1": 2,
        "competitor2": 8,
        "audio": "a",
        "condition": "all",
    }
    onsets = spark.createDataFrame([("a", 100.0)], "Prime string, click_onset_ms double")
    for name in ("gender", "determiner", "name", "noun"):
        onsets = onsets.withColumn(f"{name}_onset_ms", F.lit(5000.0))
    return gaze.add_onsets(gaze.locate(spark.createDataFrame([trial])), onsets)


def test_list_and_long_routes_agree(spark):
    trials = gaze_trial(spark)
    listed = gaze.binned_looks(gaze.looks_from_lists(trials))
    long = gaze.binned_looks(gaze.classify(explode_parallel(trials, gaze.SERIES, sep=",")))
    columns = ["webgazer_time", "look", "ROI", "relative_time", "binned_time_relative"]
    # Time zero is the first classified sample, at 5; only the last sample is late enough.
    assert rows(listed.select(*columns)) == rows(long.select(*columns)) == [(1300.0, "topleft", "target", 1295.0, 100)]


def test_classified_and_raw_origin_differ(spark):
    trials = gaze_trial(spark).withColumn("x", F.lit("[500, 640, 640, 10]")).withColumn("y", F.lit("[300, 375, 375, 10]"))
    looks = gaze.classify(explode_parallel(trials, gaze.SERIES, sep=","))
    classified = gaze.aligned_looks(looks).agg(F.min("first_sample")).first()[0]
    raw = gaze.aligned_looks(looks, origin="raw").agg(F.min("first_sample")).first()[0]
    assert (classified, raw) == (10.0, 5.0)


def test_window_and_box_lookup(spark):
    samples = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 10.0), ("a", 99.0), ("b", 5.0)], "audio string, t double")
    onsets = spark.createDataFrame([("a", "w1", 0.0), ("a", "w2", 10.0), ("b", "w1", 6.0)], "audio string, window string, onset_ms double")
    found = lookup.lookup_window(samples, onsets, ["audio"], ["w1", "w2"], "t")
    assert rows(found) == [("a", -1.0, "preview"), ("a", 0.0, "w1"), ("a", 10.0, "w2"), ("a", 99.0, "w2"), ("b", 5.0, "preview")]
    boxes = spark.createDataFrame([(1, "q", 0.0, 9.0, 0.0, 9.0), (1, "z", 5.0, 20.0, 0.0, 9.0)], "l int, box string, x_min double, x_max double, y_min double, y_max double")
    points = spark.createDataFrame([(1, 6.0, 1.0), (1, 9.0, 1.0), (1, 0.0, 1.0), (2, 6.0, 1.0)], "l int, x double, y double")
    assert rows(lookup.lookup_box(points, boxes, ["l"], ["q", "z"])) == [(1, 0.0, 1.0, "other"), (1, 6.0, 1.0, "q"), (1, 9.0, 1.0, "z"), (2, 6.0, 1.0, "other")]


def test_centring_and_contrasts(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 3), ("b", 8.0, 1)], "g string, v double, n int")
    coded = coding.with_alphabetical_code(df, "g", "code")
    out = coding.centre(coded, {"cv": "v", "cg": "code"})
    assert [round(r.cv, 9) for r in out.orderBy("v").collect()] == [-3.0, -1.0, 4.0]
    assert [round(r.cg, 9) for r in out.orderBy("v").collect()] == [round(1 - 4 / 3, 9)] * 2 + [round(2 - 4 / 3, 9)]
    keyed = coding.centre(df, {"cv": "v"}, ["g"], weight="n")
    assert sorted(r.cv for r in keyed.collect()) == [-1.5, 0.0, 0.5]
    assert list(coding.dummies("g", ["a", "b"], "a")) == ["g_b"]
    assert rows(coding.centre(coded, {"x": coding.category_code("g", ["a", "b"]) - F.col("code")}).select("x")) == [(0.0,)] * 3
    some = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert sorted(r.cv for r in coding.centre(some, {"cv": "v"}, ["g"]).collect()) == [-1.0, 0.0, 1.0]
    many = spark.range(20_000).select(F.format_string("k%05d", "id").alias("g")).unionByName(some.select("g"))
    found = coding.with_alphabetical_code(many, "g", "code")
    assert found.where("g IS NOT NULL AND g <> 'a' AND code <> cast(substring(g, 2) AS int) + 2").count() == 0
    assert {(r.g, r.code) for r in found.where("g IS NULL OR g = 'a'").collect()} == {(None, None), ("a", 1)}


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) + 50
    group = rng.integers(0, 2, 300)
    y = 2 + x @ np.array([0.5, -1.5]) + group + rng.normal(size=300)
    data = [(int(g), *map(float, row), float(v)) for g, row, v in zip(group, x, y)]
    df = spark.createDataFrame(data, "g int, a double, b double, y double")
    got = regression.ols(df, "y", ["a", "b"], ["g"]).collect()
    for g in (0, 1):
        design = np.column_stack([np.ones((group == g).sum()), x[group == g]])
        beta, rest, *_ = np.linalg.lstsq(design, y[group == g], rcond=None)
        sigma2 = rest[0] / (len(design) - 3)
        error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sigma2)
        found = {r.term: r for r in got if r.g == g}
        assert [found[t].estimate for t in ("(Intercept)", "a", "b")] == pytest.approx(beta.tolist(), rel=1e-6)
        assert [found[t].std_error for t in ("(Intercept)", "a", "b")] == pytest.approx(error.tolist(), rel=1e-6)


def test_cells_fit_like_rows_and_match_logits(spark):
    data = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 5 + [("b", 0)] * 35
    df = spark.createDataFrame(data, "g string, y int").withColumn("g_b", (F.col("g") == "b").cast("int"))
    cells = regression.model_cells(df, ["g_b"], "y")
    single = df.withColumns({"p": F.col("y").cast("double"), "n": F.lit(1)})
    fits = [{r.term: r for r in regression.logistic(d, ["g_b"]).collect()} for d in (cells, single)]
    for term, want in (("(Intercept)", np.log(3)), ("g_b", np.log(1 / 7) - np.log(3))):
        assert fits[0][term].estimate == pytest.approx(want, abs=1e-6)
        assert fits[1][term].estimate == pytest.approx(want, abs=1e-6)
        assert fits[0][term].std_error == pytest.approx(fits[1][term].std_error, rel=1e-6)
    assert fits[0]["(Intercept)"].std_error == pytest.approx((1 / 30 + 1 / 10) ** 0.5, rel=1e-5)


def test_variance_inflation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double")
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    got = {r.term: r.vif for r in regression.variance_inflation(df, ["a", "b", "c"]).collect()}
    assert [got[t] for t in "abc"] == pytest.approx(want.tolist())


def test_correlation_and_slopes(spark):
    df = spark.createDataFrame([("u", 1.0, 2.0), ("u", 2.0, 4.0), ("u", 3.0, 6.0), ("v", 1.0, 1.0), ("v", 2.0, 3.0), ("v", 3.0, 2.0), ("v", None, 1.0)], "g string, a double, b double")
    got = {r.g: r for r in correlation.with_p(correlation.correlation(df, "a", "b", ["g"])).collect()}
    assert got["u"].r == pytest.approx(1) and got["v"].r == pytest.approx(0.5)
    assert got["v"].dof == 1 and got["v"].t == pytest.approx(0.5 / 0.75**0.5)
    assert got["v"].p == pytest.approx(2 / 3)
    slopes = correlation.unit_slopes(df, "b", "a", ["g"])
    summary = correlation.slope_summary(slopes).first()
    assert (summary.mean_slope, summary.n_units) == (pytest.approx(1.25), 2)


def test_calibration_score(spark):
    data = [(1, i, 640.0, 375.0 + (375.0 if i % 2 else 0.0)) for i in range(60)] + [(2, i, 640.0, 375.0) for i in range(50)]
    df = spark.createDataFrame(data, "workerid int, point_no int, x double, y double")
    df = df.withColumns({"windowW": F.lit(1280), "windowH": F.lit(750)})
    assert rows(calibration.calibration_accuracy(df)) == [(1, 50), (2, 100)]


def test_sessions_against_brute_force(spark):
    rng = random.Random(8)
    data = [(0 if rng.random() < 0.4 else rng.randrange(1, 6), rng.randrange(0, 40_000)) for _ in range(900)]
    df = spark.createDataFrame(data, "w int, t bigint")
    got = rows(sessions.trial_sessions(df, ["w"], F.col("t"), 150))
    by_worker, want = defaultdict(list), []
    for w, t in data:
        by_worker[w].append(t)
    for w, times in by_worker.items():
        number, group = 0, []
        for t in sorted(times):
            if group and t - group[-1] >= 150:
                number += 1
                want.append((w, number, group[0], group[-1], len(group)))
                group = []
            group.append(t)
        want.append((w, number + 1, group[0], group[-1], len(group)))
    assert got == sorted(want)


def test_null_lists_give_no_samples(spark):
    df = spark.createDataFrame([(1, None, None), (2, [1.0], [2.0])], "id int, a array<double>, b array<double>")
    assert rows(explode_parallel(df, {"a": "double", "b": "double"})) == [(2, 1.0, 2.0)]


def test_models_without_rows_or_errors(spark):
    data = [("w1", i % 2, i % 2, 1.0 if i % 3 else 0.0) for i in range(40)]
    df = spark.createDataFrame(data, "window string, a int, b int, y double")
    cells = regression.model_cells(df, ["window", "a", "b"], "y")
    found = regression.logistic_by_window(cells, ["w1", "w2"], ["a", "b"]).collect()
    assert {r.window for r in found} == {"w1"}
    assert len(found) == 3
    with pytest.raises(ValueError):
        regression.logistic_by_window(cells, ["w2"], ["a"])
    inflation = regression.variance_inflation(df, ["a", "b"]).collect()
    assert all(r.vif > 1e6 for r in inflation)


@pytest.mark.parametrize("parts", [None, 9])
def test_quantiles_keep_the_null_group(spark, parts):
    data = [("a", float(i)) for i in range(9)] + [(None, float(i)) for i in range(0, 50, 2)]
    df = spark.createDataFrame(data, "g string, v double")
    got = stats.quantiles(df, ["g"], "v", (0.25, 0.5), mean="m", parts=parts).collect()
    assert {r.g: (*r.quantiles, r.m) for r in got} == {"a": (2.0, 4.0, 4.0), None: (12.0, 24.0, 24.0)}


@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "date", "boolean"])
def test_hot_numbering_by_other_types(spark, kind):
    base = spark.range(40).select(F.lit("w").alias("w"), "id")
    order = {
        "string": F.format_string("k%03d", "id"),
        "timestamp_ntz": F.expr("timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)"),
        "date": F.expr("date_add(date '2020-01-01', cast(id as int))"),
        "boolean": F.col("id") >= 20,
    }[kind]
    df = base.withColumn("o", order)
    got = ranking.number_within(df, ["w"], ["o", "id"], parts=7).collect()
    assert all(r.trial_number == r.id + 1 for r in got) and len(got) == 40


def test_bootstrap_has_one_law_at_every_size(spark):
    """Variances of replicate means follow from drawing n rows with replacement, in one part and in very many."""
    rng = np.random.default_rng(8)
    groups = {"few": rng.exponential(2, 100), "many": rng.exponential(2, 100_000), None: rng.normal(5, 1, 5_000)}
    df = spark.createDataFrame(
        spark.sparkContext.parallelize([(k, float(v)) for k, vs in groups.items() for v in vs], 4), "g string, v double"
    )
    for size in (1024, 200_000):
        got = {r.g: r for r in bootstrap.bootstrap_mean(df, ["g"], "v", part_values=size).collect()}
        assert set(got) == set(groups)
        for key, values in groups.items():
            error = 1.96 * values.std() / len(values) ** 0.5
            assert got[key].n == len(values) and got[key].mean == pytest.approx(values.mean())
            assert got[key].CILow == pytest.approx(error, rel=0.2) and got[key].CIHigh == pytest.approx(error, rel=0.2)
    some = df.where("g = 'few' OR g IS NULL")
    once = {tuple(r) for r in bootstrap.bootstrap_mean(some, ["g"], "v", part_values=64).collect()}
    again = {tuple(r) for r in bootstrap.bootstrap_mean(some.repartition(3), ["g"], "v", part_values=64).collect()}
    assert {r[0]: pytest.approx(r[1:], rel=1e-9) for r in once} == {r[0]: r[1:] for r in again}
    whole = bootstrap.bootstrap_mean(df, [], "v").first()
    assert whole.n == 105_100


def test_replicates_draw_exactly_as_many_rows(spark):
    """Values of a constant group add up to n in every replicate, over all parts of the tree."""
    df = spark.range(3000).select((F.col("id") % 2000).cast("double").alias("v"))
    cells = df.groupBy("v").agg(F.count("*").alias("_c")).select(F.lit(1).alias("_all"), F.col("v").alias("_v"), "_c")
    found = bootstrap._group_sizes(cells, ["_all"], 16).first()
    assert (found.n, found._depth) == (3000, 7)
    moved = bootstrap.bootstrap_mean(df.withColumn("v", F.col("v") * 0 + 1), [], "v", part_values=1).first()
    assert (moved.mean, moved.CILow, moved.CIHigh) == (1.0, 0.0, 0.0)
    wide = bootstrap.bootstrap_mean(df.withColumn("v", 1e6 + F.col("v") / 1e6), [], "v", part_values=16).first()
    assert abs(wide.CILow) < 1e-3 and abs(wide.CIHigh) < 1e-3


def test_no_plan_orders_a_whole_key(spark):
    df = spark.createDataFrame(hot_rows(200), "w int, o int, id int")
    plan = ranking.number_within(df, ["w"], ["o"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rank(" not in plan
