"""Grouped fits, aliased terms, inflation and unit effects against plain linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.operators import correlation, regression
from gazeframe.plans import gaze


def newton(x, y):
    """Row-level logistic fit: coefficients and covariance."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        information = (x * (mu * (1 - mu))[:, None]).T @ x
        beta = beta + np.linalg.solve(information, x.T @ (y - mu))
    return beta, np.linalg.inv(information)


def looks(seed, n):
    """Samples with times since every onset, in all windows."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 3500, n)
    onset = {"click": 0, "gender": 500, "determiner": 1100, "name": 1700, "noun": 2300}
    window = np.select([t < 500, t < 1100, t < 1700, t < 2300], ["baseline", "gender", "determiner", "name"], "noun")
    size = rng.integers(1, 3, n)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + 0.4 * (size - 1.5) + (t - 1500) / 4000)))).astype(int)
    return [
        (str(w), float(s), int(v), *[float(x - at) for at in onset.values()]) for w, s, v, x in zip(window, size, y, t)
    ], onset


def test_window_models_equal_fits_of_single_rows(spark):
    data, onset = looks(3, 4000)
    names = [f"time_rel_{o}_onset" for o in onset]
    frame = spark.createDataFrame(data, "window string, size double, y int, " + ", ".join(f"{n} double" for n in names))
    made = gaze.model_looks(frame)
    rows = made.withColumns({"p": F.col("y").cast("double"), "n": F.lit(1), "both": F.col("size") * F.col("model_time")})
    xs = ["size", "model_time", "both"]
    fit = regression.logistic_fit(rows, xs, ["model"])
    found = {r.model: r for r in fit.collect()}
    assert set(found) == set(gaze.MODEL_WINDOWS) and all(r.converged for r in found.values())
    for model, (windows, origin) in gaze.MODEL_WINDOWS.items():
        at = names.index(f"time_rel_{origin}_onset") + 3
        some = [r for r in data if r[0] in windows and (r[0] != "noun" or r[-1] < 600)]
        time = np.array([r[at] for r in some]) / 100
        size = np.array([r[1] for r in some])
        beta, covariance = newton(np.column_stack([size, time, size * time]), np.array([r[2] for r in some]))
        assert found[model].n == len(some)
        assert found[model].beta == pytest.approx(beta.tolist(), rel=1e-5)
        assert found[model].covariance == pytest.approx(covariance.ravel().tolist(), rel=1e-4)
        spread = np.sqrt(np.diag(covariance)[1:])
        want = np.diag(np.linalg.inv(covariance[1:, 1:] / np.outer(spread, spread)))
        vif = {r.term: r.vif for r in regression.inflation(fit.where(F.col("model") == model), xs, ["model"]).collect()}
        assert [vif[x] for x in xs] == pytest.approx(want.tolist(), rel=1e-4)


def test_groups_converge_apart_and_a_null_key_is_a_group(spark):
    """One group can be told apart perfectly and is flagged; the others are not disturbed."""
    rng = np.random.default_rng(1)
    data = []
    for key in ("a", None, "c"):
        x = rng.normal(size=200)
        y = x > 0 if key == "c" else rng.uniform(size=200) < 1 / (1 + np.exp(-x))
        data += [(key, float(a), float(b), 1) for a, b in zip(x, y)]
    frame = spark.createDataFrame(data, "g string, x double, p double, n int")
    found = {r.g: r for r in regression.logistic_fit(frame, ["x"], ["g"], most_rounds=12).collect()}
    assert {g: r.converged for g, r in found.items()} == {"a": True, None: True, "c": False}
    assert found["c"].rounds == 12 and found["a"].rounds < 12
    for key in ("a", None):
        x = np.array([r[1] for r in data if r[0] == key])
        beta, _ = newton(x[:, None], np.array([r[2] for r in data if r[0] == key]))
        assert found[key].beta == pytest.approx(beta.tolist(), rel=1e-6)


def test_aliased_terms_are_null(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 60)) * 100 + 5000
    y = 3 + 0.5 * x - z + rng.normal(size=60)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, y)], "x double, z double, y double")
    frame = frame.withColumns({"twice": 2 * F.col("x"), "fixed": F.lit(7.0), "sum": F.col("x") + F.col("z")})
    found = {r.term: r for r in regression.ols(frame, "y", ["x", "twice", "fixed", "z", "sum"]).collect()}
    plain = {r.term: r for r in regression.ols(frame, "y", ["x", "z"]).collect()}
    for term in ("twice", "fixed", "sum"):
        assert found[term].estimate is None and found[term].std_error is None and found[term].p is None
    for term in ("(Intercept)", "x", "z"):
        assert found[term].estimate == pytest.approx(plain[term].estimate, rel=1e-9)
        assert found[term].std_error == pytest.approx(plain[term].std_error, rel=1e-9)
        assert found[term].p == pytest.approx(plain[term].p, rel=1e-6, abs=1e-300)
    shares = frame.withColumns({"p": (F.col("y") > -2500).cast("double"), "n": F.lit(3)})
    shares = shares.withColumns({"x": F.col("x") / 100 - 50, "twice": F.col("x") / 50 - 100, "z": F.col("z") * 0 + F.rand(3)})
    fit = regression.logistic_fit(shares, ["z", "x", "twice"]).first()
    assert fit.beta[3] is None and fit.beta[2] is not None and fit.dof == fit.n - 3


def test_inflation_of_one_term_and_of_weighted_predictors(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 50))
    b += a
    n = rng.integers(1, 5, 50)
    data = [(float(p), float(q), int(k)) for p, q, k in zip(a, b, n)]
    frame = spark.createDataFrame(data, "a double, b double, n int")
    assert [r.vif for r in regression.variance_inflation(frame, ["a"]).collect()] == pytest.approx([1.0])
    single = frame.select("a", "b", F.explode(F.sequence(F.lit(1), "n")))
    heavy = [r.vif for r in regression.variance_inflation(frame, ["a", "b"], "n").collect()]
    assert heavy == pytest.approx([r.vif for r in regression.variance_inflation(single, ["a", "b"]).collect()])
    r = np.corrcoef(np.repeat(a, n), np.repeat(b, n))[0, 1]
    assert heavy[0] == pytest.approx(1 / (1 - r * r))
    fixed = frame.withColumn("c", F.lit(1.0))
    assert {x.term: x.vif for x in regression.variance_inflation(fixed, ["a", "c"]).collect()} == {"a": pytest.approx(1.0), "c": None}
    fit = regression.ols_fit(frame, "b", ["a"])
    assert [x.vif for x in regression.inflation(fit, ["a"]).collect()] == pytest.approx([1.0])


def test_unit_effects_are_null_where_a_unit_cannot_tell(spark):
    data = [("u", 0.0, t, 2.0 + t) for t in (0.0, 1.0, 2.0)]
    data += [("v", c, t, 1.0 + 3 * c - 0.5 * t) for c in (0.0, 1.0) for t in (0.0, 1.0, 2.0)]
    data += [("w", 1.0, 1.0, 5.0)]
    frame = spark.createDataFrame(data, "unit string, c double, t double, y double")
    found = {(r.unit, r.term): r.estimate for r in correlation.unit_effects(frame, "y", ["c", "t"], ["unit"]).collect()}
    assert found["u", "c"] is None and found["u", "t"] == pytest.approx(1.0)
    assert found["v", "c"] == pytest.approx(3.0) and found["v", "t"] == pytest.approx(-0.5)
    assert found["w", "c"] is None and found["w", "t"] is None and found["w", "(Intercept)"] == pytest.approx(5.0)
    slopes = correlation.unit_effects(frame, "y", ["c", "t"], ["unit"]).withColumnRenamed("estimate", "slope")
    summed = {r.term: r for r in correlation.slope_summary(slopes, ["term"]).collect()}
    assert (summed["t"].n_units, summed["c"].n_units) == (2, 1) and summed["t"].mean_slope == pytest.approx(0.25)


def test_models_of_no_rows(spark):
    frame = spark.createDataFrame([], "g string, x double, y double, p double, n int")
    assert regression.ols(frame, "y", ["x"], ["g"]).collect() == []
    assert regression.logistic_fit(frame, ["x"], ["g"]).collect() == []
    assert regression.variance_inflation(frame, ["x"]).collect() == []
