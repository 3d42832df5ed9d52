"""Queries of correlation and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe.catalog import solve_sql
from gazeframe.catalog import standins as S
from gazeframe.catalog.aggregates import belief_rows, collapsed
from gazeframe.catalog.common import r, rounded
from gazeframe.catalog.derived import aligned, long_clicks
from gazeframe.catalog.registry import query
from gazeframe.catalog.standins import sql
from gazeframe.functions.scores import recode
from gazeframe.operators import correlation as C
from gazeframe.operators import regression as G
from gazeframe.operators.alignment import bin_time, label_windows
from gazeframe.operators.coding import centre, dummies, interactions
from gazeframe.operators.relational import with_any_look
from gazeframe.plans.belief import MERGED_DETERMINERS
from gazeframe.plans.gaze import MODEL_WINDOWS, NOUN_CUT_MS, model_looks
from gazeframe.session import stored

# Analysis windows of the models, and their category levels.
BELIEF_WINDOWS = ("baseline", "gender", "determiner+name", "noun")
CLICK_WINDOWS = ("click1", "click2", "click3", "click4")
CONDITIONS = ("all", "num", "some")


def _corr_sql(keys: str, source: str = "belief") -> str:
    head = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {head}{r('rr')} AS r, dof, {r('rr * sqrt(dof / (1 - rr * rr))')} AS t
        FROM (SELECT {head}corr(prop_looks, prop_selections) AS rr, count(*) - 2 AS dof FROM {source}
              WHERE prop_looks IS NOT NULL AND prop_selections IS NOT NULL {group})"""


@query("I1", sql("belief", _corr_sql("")))
def correlation_overall(spark, sf):
    return rounded(C.correlation(belief_rows(spark, sf), "prop_looks", "prop_selections"))


def _corr_p_sql(key: str, whole: str = "", source: str = "belief") -> str:
    """Correlations with p per value of ``key``, and over all rows under the name ``whole``."""
    pairs = f"(SELECT * FROM {source} WHERE prop_looks IS NOT NULL AND prop_selections IS NOT NULL)"
    sums = "corr(prop_looks, prop_selections) AS rr, count(*) - 2 AS dof"
    groups = f"SELECT {key}, {sums} FROM {pairs} GROUP BY {key}"
    if whole:
        groups += f" UNION ALL SELECT '{whole}', {sums} FROM {pairs}"
    return f"""SELECT {key}, {r('rr')} AS r, dof, {r('tt')} AS t, {r(solve_sql.t_p('tt', 'dof'))} AS p
        FROM (SELECT *, rr * sqrt(dof / (1 - rr * rr)) AS tt FROM ({groups}))"""


@query("I1", sql("belief", _corr_p_sql('"window"', "all")))
def correlation_with_p(spark, sf):
    """Overall and per window, with two-sided p-values."""
    rows = belief_rows(spark, sf)
    whole = C.correlation(rows, "prop_looks", "prop_selections").withColumn("window", F.lit("all"))
    each = C.correlation(rows, "prop_looks", "prop_selections", ["window"])
    return rounded(C.with_p(whole.unionByName(each)))


@query("I2 I1", sql("belief", _corr_p_sql('"Region"')))
def correlation_by_region_with_p(spark, sf):
    """Each region's own test."""
    return rounded(C.with_p(C.correlation(belief_rows(spark, sf), "prop_looks", "prop_selections", ["Region"])))


@query(
    "I2 I1",
    sql(
        "belief",
        _corr_p_sql("determiner, size", source="(SELECT * FROM belief WHERE \"window\" = 'determiner+name')"),
    ),
)
def correlation_by_condition_with_p(spark, sf):
    """Each determiner and size within the determiner window, with its test."""
    rows = belief_rows(spark, sf).where(F.col("window") == "determiner+name")
    return rounded(C.with_p(C.correlation(rows, "prop_looks", "prop_selections", ["determiner", "size"])))


@query(
    "I2 I1 F19",
    sql(
        "belief",
        _corr_p_sql(
            '"window"',
            source="""(SELECT "window", "Region", determiner, size, avg(prop_looks) AS prop_looks, avg(prop_selections) AS prop_selections
                FROM belief GROUP BY ALL)""",
        ),
    ),
)
def correlation_over_items_with_p(spark, sf):
    """Tests after averaging over items."""
    return rounded(C.with_p(C.correlation(collapsed(spark, sf), "prop_looks", "prop_selections", ["window"])))


@query("I2", sql("belief", _corr_sql('"window"')))
def correlation_by_window(spark, sf):
    return rounded(C.correlation(belief_rows(spark, sf), "prop_looks", "prop_selections", ["window"]))


@query("I2", sql("belief", _corr_sql('"Region"')))
def correlation_by_region(spark, sf):
    return rounded(C.correlation(belief_rows(spark, sf), "prop_looks", "prop_selections", ["Region"]))


@query(
    "I2",
    sql("belief", _corr_sql("determiner, size", "(SELECT * FROM belief WHERE \"window\" = 'determiner+name')")),
)
def correlation_by_condition(spark, sf):
    """Per determiner and size within the determiner window."""
    rows = belief_rows(spark, sf).where(F.col("window") == "determiner+name")
    return rounded(C.correlation(rows, "prop_looks", "prop_selections", ["determiner", "size"]))


@query(
    "I2 F19",
    sql(
        "belief",
        _corr_sql(
            '"window"',
            """(SELECT "window", "Region", determiner, size, avg(prop_looks) AS prop_looks, avg(prop_selections) AS prop_selections
                FROM belief GROUP BY ALL)""",
        ),
    ),
)
def correlation_over_items(spark, sf):
    """Per window after averaging over items."""
    return rounded(C.correlation(collapsed(spark, sf), "prop_looks", "prop_selections", ["window"]))


_BELIEF_LEVELS = {
    "window": (BELIEF_WINDOWS, "determiner+name"),
    "Region": (("target", "competitor", "distractor"), "target"),
    "determiner": (("all", "number", "some"), "all"),
    "size": (("big", "small"), "big"),
}


def _slope_model(rows, factors):
    """Looks on centred selections, with slopes that differ by the levels of ``factors``."""
    coded = centre(rows, {"c": "prop_selections"})
    levels = {}
    for factor in factors:
        names, reference = _BELIEF_LEVELS[factor]
        levels |= dummies(factor, names, reference)
    products = interactions(["c"], list(levels))
    return rounded(G.ols(coded.withColumns(levels).withColumns(products), "prop_looks", ["c", *products]))


def _slope_model_sql(factors, where: str = "TRUE") -> str:
    slopes = {}
    for factor in factors:
        names, reference = _BELIEF_LEVELS[factor]
        slopes |= {
            f"c__{factor}_{level}": f"""c * CAST("{factor}" = '{level}' AS INT)""" for level in names if level != reference
        }
    columns = ", ".join(f'{text} AS "{name}"' for name, text in slopes.items())
    source = f"""(SELECT prop_looks, c, {columns} FROM (
        SELECT *, prop_selections - avg(prop_selections) OVER () AS c FROM belief WHERE {where}))"""
    terms = solve_sql.ols(source, "prop_looks", ["c", *slopes])
    return sql(
        "belief",
        f"""SELECT term, {r('estimate')} AS estimate, {r('std_error')} AS std_error, {r('t')} AS t,
            {r(solve_sql.t_p('t', 'dof'))} AS p, n FROM ({terms})""",
    )


@query("I3 D17 D18", _slope_model_sql(["window", "Region"]))
def linear_model(spark, sf):
    """Slopes by window and region."""
    return _slope_model(belief_rows(spark, sf), ["window", "Region"])


@query("I3 D17 D18", _slope_model_sql(["window", "Region", "determiner", "size"]))
def linear_model_with_conditions(spark, sf):
    """Slopes by window, region, determiner and size."""
    return _slope_model(belief_rows(spark, sf), ["window", "Region", "determiner", "size"])


@query("I3 D17 D18", _slope_model_sql(["window"], "\"Region\" = 'target'"))
def linear_model_of_targets(spark, sf):
    """Target rows alone, centred among themselves."""
    return _slope_model(belief_rows(spark, sf).where(F.col("Region") == "target"), ["window"])


@query(
    "I3",
    f"""SELECT term, {r('estimate')} AS estimate, {r('std_error')} AS std_error, n FROM ({solve_sql.ols(
        '(SELECT l_tax, l_quantity, 2 * l_quantity AS twice, l_discount, l_quantity - l_discount AS less FROM lineitem)',
        'l_tax', ['l_quantity', 'twice', 'l_discount', 'less'])})""",
)
def linear_model_with_aliased_terms(spark, sf):
    """Terms that earlier ones explain have no estimate; the others are as if these were not there."""
    lines = S.table(spark, sf, "lineitem").withColumns(
        {"twice": 2 * F.col("l_quantity"), "less": F.col("l_quantity") - F.col("l_discount")}
    )
    found = G.ols(lines, "l_tax", ["l_quantity", "twice", "l_discount", "less"])
    return rounded(found.select("term", "estimate", "std_error", "n"))


@query(
    "I3",
    f"""SELECT l_returnflag, term, {r('estimate')} AS estimate, n FROM (
        SELECT l_returnflag, n, unnest(['(Intercept)', 'l_quantity', 'l_discount']) AS term,
            unnest([my - b1 * m1 - b2 * m2, b1, b2]) AS estimate
        FROM (
            SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2
            FROM (
                SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS my,
                    var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
                    covar_pop(l_quantity, l_tax) AS s1y, covar_pop(l_discount, l_tax) AS s2y
                FROM lineitem GROUP BY l_returnflag)))""",
)
def linear_model_two_predictors(spark, sf):
    """Two predictors per group, which SQL can solve in closed form."""
    found = G.ols(S.table(spark, sf, "lineitem"), "l_tax", ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(found.select("l_returnflag", "term", "estimate", "n"))


_FIT = "regr_slope(y, c) FILTER (\"Region\" = '{0}') AS b_{1}, regr_intercept(y, c) FILTER (\"Region\" = '{0}') AS a_{1}"


@query(
    "I5 D17 D18",
    sql(
        "belief",
        f"""SELECT "window", unnest(['(Intercept)', 'c', 'Region_competitor', 'Region_distractor', 'c__Region_competitor', 'c__Region_distractor']) AS term,
            unnest([{r('a_t')}, {r('b_t')}, {r('a_c - a_t')}, {r('a_d - a_t')}, {r('b_c - b_t')}, {r('b_d - b_t')}]) AS estimate, n
        FROM (SELECT "window", count(y) AS n, {_FIT.format('target', 't')}, {_FIT.format('competitor', 'c')}, {_FIT.format('distractor', 'd')}
            FROM (SELECT "window", "Region", prop_looks AS y, prop_selections - avg(prop_selections) OVER (PARTITION BY "window") AS c FROM belief)
            GROUP BY "window")""",
    ),
)
def linear_models_by_window(spark, sf):
    """The same linear model in every window, all from one aggregation."""
    rows = centre(belief_rows(spark, sf).persist(), {"c": "prop_selections"}, ["window"])
    coded = rows.withColumns(dummies("Region", ("target", "competitor", "distractor"), "target"))
    names = ["Region_competitor", "Region_distractor"]
    products = interactions(["c"], names)
    found = G.ols(coded.withColumns(products), "prop_looks", ["c", *names, *products], ["window"])
    return rounded(found.select("window", "term", "estimate", "n"))


def window_looks(spark, sf):
    """Target or competitor looks in the model span, with window and shifted onsets."""
    found = bin_time(aligned(spark, sf, shift=200))
    kept = with_any_look(label_windows(found), ("target", "competitor"))
    return kept.withColumn("time_100", F.col("time_rel_determiner_onset") / 100)


_MODEL_SQL = """SELECT * FROM (
        SELECT *, CASE WHEN tc < 0 THEN 'preview' WHEN tg < 0 THEN 'baseline' WHEN td < 0 THEN 'gender'
            WHEN tn < 0 THEN 'determiner' WHEN tu < 0 THEN 'name' ELSE 'noun' END AS "window"
        FROM (SELECT *, relative_time - 1000 - click_onset_ms_200shift AS tc, relative_time - 1000 - gender_onset_ms_200shift AS tg,
                relative_time - 1000 - determiner_onset_ms_200shift AS td, relative_time - 1000 - name_onset_ms_200shift AS tn,
                relative_time - 1000 - noun_onset_ms_200shift AS tu FROM aligned)
        WHERE tc >= 0 AND tc < 4000 AND (target_look = 1 OR competitor_look = 1))"""


@query(
    "I10",
    sql(
        "aligned",
        f"""SELECT "window", condition, size, CAST(floor(tc / 100) * 100 AS DOUBLE) AS bin, CAST(sum(target_look) AS BIGINT) AS k,
            count(*) AS n, {r('avg(target_look)')} AS p FROM ({_MODEL_SQL}) GROUP BY ALL""",
    ),
)
def model_cell_table(spark, sf):
    """Binomial counts of target looks per design cell."""
    looks = window_looks(spark, sf).withColumn("bin", F.col("binned_time_relative").cast("double"))
    return rounded(G.model_cells(looks, ["window", "condition", "size", "bin"], "target_look"))


CONDITION_TERMS = ("condition_all", "condition_some")
GAZE_TERMS = (
    *CONDITION_TERMS,
    "csize",
    "ctime",
    *[f"{c}__{x}" for c in CONDITION_TERMS for x in ("csize", "ctime")],
    "csize__ctime",
    *[f"{c}__csize__ctime" for c in CONDITION_TERMS],
)


def _crossed(coded, factor):
    """Dummies of a factor, and their products with ``csize`` and ``ctime`` up to all three."""
    names = list(factor)
    pairs = interactions(names, ["csize", "ctime"]) | interactions(["csize"], ["ctime"])
    triples = interactions([f"{n}__csize" for n in names], ["ctime"])
    return coded.withColumns(factor).withColumns(pairs).withColumns(triples)


def _gaze_cells(spark, sf):
    """Binomial cells of every model at the samples' own times, not binned."""
    looks = model_looks(window_looks(spark, sf))
    return G.model_cells(looks, ["model", "condition", "size", "model_time"], "target_look")


def _gaze_design(cells):
    """Condition contrasts against ``num``, size and time centred over the samples of a model, and all products."""
    size = F.when(F.col("size") == "small", 1).otherwise(2)
    coded = centre(cells, {"csize": size, "ctime": "model_time"}, ["model"], weight="n")
    return _crossed(coded, dummies("condition", CONDITIONS, "num"))


def _gaze_fit(spark, sf):
    return G.logistic_fit(_gaze_design(stored(_gaze_cells(spark, sf), "cells")), GAZE_TERMS, ["model"])


def _product_sql(terms) -> str:
    """Products named ``a__b`` from columns ``a`` and ``b``."""
    return ", ".join(f"{t.replace('__', ' * ')} AS \"{t}\"" for t in terms if "__" in t)


def _centred_cells_sql(cells: str, key: str, size_code: str, time: str | None, dummies_sql: str, terms) -> str:
    """CTEs ``cells`` and ``design`` of a model on binomial cells, centred per ``key`` over their rows."""
    ctime = f""", {time} - sum({time} * n) OVER w / sum(n) OVER w AS ctime""" if time else ""
    return f"""cells AS MATERIALIZED ({cells}),
        design AS MATERIALIZED (SELECT *, {_product_sql(terms)} FROM (
            SELECT *, {dummies_sql}, {size_code} - sum(({size_code}) * n) OVER w / sum(n) OVER w AS csize {ctime}
            FROM cells WINDOW w AS (PARTITION BY "{key}")))"""


_CONDITION_SQL = "CAST(condition = 'all' AS INT) AS condition_all, CAST(condition = 'some' AS INT) AS condition_some"
_CELL_SUMS = "avg({0}) AS p, count(*) AS n"
_MODEL_CHOICE = ", ".join(
    f"""CASE WHEN "window" IN ({', '.join(f"'{w}'" for w in names)}) THEN {{'model': '{model}', 'model_time': t{onset[0] if onset != 'noun' else 'u'} / 100}} END"""
    for model, (names, onset) in MODEL_WINDOWS.items()
)
_MODEL_LOOKS_SQL = f"""SELECT condition, size, workerid, "Noun", target_look, c.model AS model, c.model_time AS model_time FROM (
        SELECT *, unnest([{_MODEL_CHOICE}]) AS c FROM ({_MODEL_SQL}) WHERE "window" <> 'noun' OR tu < {NOUN_CUT_MS}) WHERE c IS NOT NULL"""


def _fit_sql(views: str, cells: str, key: str, size_code: str, time, dummies_sql: str, terms, body) -> str:
    """``body`` of the last round's table, behind the views, cells, design and rounds of a grouped fit."""
    rounds, last = solve_sql.logistic("design", terms, [key] if key else [])
    return sql(views, "SELECT 0").rsplit("SELECT 0", 1)[0] + f""",
        {_centred_cells_sql(cells, key, size_code, time, dummies_sql, terms)}, {rounds} {body(last)}"""


def _terms_sql(terms, key: str, digits: int = 5):
    def body(last: str) -> str:
        z = solve_sql.z_p("z")
        return f"""SELECT "{key}", term, {r('estimate', digits)} AS estimate, {r('std_error', digits)} AS std_error,
            {r('z', digits)} AS z, {r(z, digits)} AS p FROM ({solve_sql.logistic_terms(last, terms, [key])})"""

    return body


_GAZE_SQL = (
    "aligned",
    f"SELECT model, condition, size, model_time, {_CELL_SUMS.format('target_look')} FROM ({_MODEL_LOOKS_SQL}) GROUP BY ALL",
    "model",
    "CASE WHEN size = 'small' THEN 1 ELSE 2 END",
    "model_time",
    _CONDITION_SQL,
    GAZE_TERMS,
)


@query("I4 I5 D17 D18", _fit_sql(*_GAZE_SQL, _terms_sql(GAZE_TERMS, "model")))
def gaze_logistic_by_window(spark, sf):
    """Target looks on condition, size and unbinned time since each model's own onset: fixed effects.

    The models are determiner and name together and the five windows alone, the noun's first 600 ms.
    """
    return rounded(G.coefficients(_gaze_fit(spark, sf), GAZE_TERMS, ["model"], student=False).drop("n"), 5)


@query(
    "I4 I5",
    sql("aligned", f"SELECT model, count(*) AS n, {r('avg(model_time)')} AS mean_time, {r('avg(target_look)')} AS p FROM ({_MODEL_LOOKS_SQL}) GROUP BY model"),
)
def model_window_sizes(spark, sf):
    """Samples, mean time and share of target looks of every model."""
    looks = model_looks(window_looks(spark, sf))
    return rounded(
        looks.groupBy("model").agg(
            F.count("target_look").alias("n"), F.avg("model_time").alias("mean_time"), F.avg("target_look").alias("p")
        )
    )


DETERMINER_TERMS = ("determiner_number", "determiner_some")
TRACKER_TERMS = tuple(t.replace("condition_all", "determiner_number").replace("condition_some", "determiner_some") for t in GAZE_TERMS)
_TRACKER_SQL = (
    "tracker",
    f"""SELECT whichword, determiner, size, CAST(time AS DOUBLE) AS time, {_CELL_SUMS.format('targetlook')} FROM (
        SELECT * EXCLUDE (determiner), CASE WHEN determiner IN ('two', 'three') THEN 'number' ELSE determiner END AS determiner FROM tracker)
        WHERE whichword IN ('determiner', 'name') AND (targetlook = 1 OR competitorlook = 1) AND targetlook IS NOT NULL GROUP BY ALL""",
    "whichword",
    "CASE WHEN size = 'big' THEN 1 ELSE 2 END",
    "time",
    "CAST(determiner = 'number' AS INT) AS determiner_number, CAST(determiner = 'some' AS INT) AS determiner_some",
    TRACKER_TERMS,
)


@query("I4 I5 D17 D18", _fit_sql(*_TRACKER_SQL, _terms_sql(TRACKER_TERMS, "whichword")))
def tracker_logistic_by_window(spark, sf):
    """Target looks of the tracker on determiner, size and sample time in two windows."""
    looks = with_any_look(S.tracker(spark, sf), ("target", "competitor"), suffix="look")
    named = looks.withColumn("determiner", recode(F.col("determiner"), MERGED_DETERMINERS))
    cells = stored(G.model_cells(named, ["whichword", "determiner", "size", "time"], "targetlook"), "cells")
    size = F.when(F.col("size") == "big", 1).otherwise(2)
    coded = centre(cells, {"csize": size, "ctime": "time"}, ["whichword"], weight="n")
    design = _crossed(coded, dummies("determiner", ("all", "number", "some"), "all"))
    return rounded(G.logistic_by_window(design, ("determiner", "name"), TRACKER_TERMS, "whichword"), 5)


def _choice_cells(spark, sf):
    clicks = with_any_look(long_clicks(spark, sf), ("target", "competitor"))
    return stored(G.model_cells(clicks, ["click_number", "condition", "size"], "target_look"), "cells")


CHOICE_TERMS = (*CONDITION_TERMS, "csize", *[f"{c}__csize" for c in CONDITION_TERMS])
_CHOICE_CELLS_SQL = f"""SELECT click_number, condition, size, {_CELL_SUMS.format('target_look')} FROM long_clicks
    WHERE (target_look = 1 OR competitor_look = 1) AND target_look IS NOT NULL GROUP BY ALL"""
_CHOICE_SQL = (
    "long_clicks",
    _CHOICE_CELLS_SQL,
    "click_number",
    "CASE WHEN size = 'big' THEN 1 ELSE 2 END",
    None,
    _CONDITION_SQL,
    CHOICE_TERMS,
)


@query("I4 I5", _fit_sql(*_CHOICE_SQL, _terms_sql(CHOICE_TERMS, "click_number")))
def choice_logistic_by_window(spark, sf):
    """Target selections on condition and centred size, alphabetical size code."""
    size = F.when(F.col("size") == "big", 1).otherwise(2)
    coded = centre(_choice_cells(spark, sf), {"csize": size}, ["click_number"], weight="n")
    coded = coded.withColumns(dummies("condition", CONDITIONS, "num"))
    design = coded.withColumns(interactions(list(CONDITION_TERMS), ["csize"]))
    return rounded(G.logistic_by_window(design, CLICK_WINDOWS, CHOICE_TERMS, "click_number"), 5)


SIMPLE_TERMS = (*CONDITION_TERMS, *[f"condition_{c}__size_small" for c in ("num", "all", "some")])


@query(
    "I6",
    _fit_sql(
        "long_clicks",
        _CHOICE_CELLS_SQL.replace("WHERE", "WHERE click_number = 'click3' AND"),
        "click_number",
        "1",
        None,
        f"{_CONDITION_SQL}, CAST(condition = 'num' AS INT) AS condition_num, CAST(size = 'small' AS INT) AS size_small",
        SIMPLE_TERMS,
        lambda last: f"SELECT * EXCLUDE (click_number) FROM ({_terms_sql(SIMPLE_TERMS, 'click_number')(last)})",
    ),
)
def simple_effects(spark, sf):
    """Size within each condition at the determiner step."""
    cells = _choice_cells(spark, sf).where(F.col("click_number") == "click3")
    coded = cells.withColumns(dummies("condition", CONDITIONS, "num"))
    coded = coded.withColumn("size_small", (F.col("size") == "small").cast("int"))
    coded = coded.withColumn("condition_num", (F.col("condition") == "num").cast("int"))
    products = interactions(["condition_num", *CONDITION_TERMS], ["size_small"])
    return rounded(G.logistic(coded.withColumns(products), SIMPLE_TERMS), 5)


@query(
    "I6 I4",
    sql(
        "long_clicks",
        f"""SELECT term, {r('estimate', 4)} AS estimate FROM (
            SELECT unnest(['(Intercept)', 'condition_all', 'condition_some', 'condition_num__size_small', 'condition_all__size_small', 'condition_some__size_small']) AS term,
                unnest([nb, ab - nb, sb - nb, ns - nb, aa - ab, ss - sb]) AS estimate
            FROM (SELECT max(l) FILTER (condition = 'num' AND size = 'big') AS nb, max(l) FILTER (condition = 'all' AND size = 'big') AS ab,
                    max(l) FILTER (condition = 'some' AND size = 'big') AS sb, max(l) FILTER (condition = 'num' AND size = 'small') AS ns,
                    max(l) FILTER (condition = 'all' AND size = 'small') AS aa, max(l) FILTER (condition = 'some' AND size = 'small') AS ss
                FROM (SELECT condition, size, ln(avg(target_look) / (1 - avg(target_look))) AS l FROM long_clicks
                    WHERE click_number = 'click3' AND (target_look = 1 OR competitor_look = 1) GROUP BY condition, size)))""",
    ),
)
def simple_effects_closed_form(spark, sf):
    """The saturated fit equals differences of cell logits, so SQL can check it."""
    return rounded(simple_effects(spark, sf).select("term", "estimate"), 4)


@query(
    "I7",
    sql(
        "subjects",
        f"""SELECT gender, {r('regr_slope(time_in_minutes, age)')} AS slope, {r('regr_intercept(time_in_minutes, age)')} AS intercept,
            {r('regr_r2(time_in_minutes, age)')} AS r2 FROM subjects GROUP BY gender""",
    ),
)
def fitted_lines(spark, sf):
    return rounded(C.fitted_line(S.subjects(spark, sf), "time_in_minutes", "age", ["gender"]))


@query(
    "I8",
    sql(
        "tracker",
        f"""SELECT unnest(['time', 'size_code']) AS term, unnest([{r('1 / (1 - rr * rr)')}, {r('1 / (1 - rr * rr)')}]) AS vif
        FROM (SELECT corr(time, CASE size WHEN 'big' THEN 1 ELSE 2 END) AS rr FROM tracker)""",
    ),
)
def variance_inflation(spark, sf):
    coded = S.tracker(spark, sf).withColumn("size_code", F.when(F.col("size") == "big", 1).otherwise(2))
    return rounded(G.variance_inflation(coded, ["time", "size_code"]))


@query(
    "I8 I4 I5",
    _fit_sql(
        *_GAZE_SQL,
        lambda last: f"SELECT model, term, {r('vif', 5)} AS vif FROM ({solve_sql.inflation(last, GAZE_TERMS, ['model'])})",
    ),
)
def variance_inflation_of_design(spark, sf):
    """All terms of every window model, from the covariance of its estimates."""
    return rounded(G.inflation(_gaze_fit(spark, sf), GAZE_TERMS, ["model"]), 5)


UNIT_TERMS = (*CONDITION_TERMS, "csize", "ctime")
_UNIT_ROWS = f"""(SELECT workerid, "Noun", target_look, {_CONDITION_SQL},
    CASE WHEN size = 'small' THEN 1 ELSE 2 END - avg(CASE WHEN size = 'small' THEN 1 ELSE 2 END) OVER () AS csize,
    model_time - avg(model_time) OVER () AS ctime
    FROM ({_MODEL_LOOKS_SQL}) WHERE model = 'determiner+name')"""


def _unit_sql(unit: str) -> str:
    return f"""SELECT "{unit}", term, {r('estimate', 5)} AS estimate, n FROM ({
        solve_sql.ols(_UNIT_ROWS, 'target_look', UNIT_TERMS, [unit])})"""


def _unit_effects(spark, sf, unit):
    """Own effects of every unit on target looks in the joint determiner and name model."""
    looks = model_looks(window_looks(spark, sf)).where(F.col("model") == "determiner+name")
    size = F.when(F.col("size") == "small", 1).otherwise(2)
    coded = centre(looks, {"csize": size, "ctime": "model_time"}).withColumns(dummies("condition", CONDITIONS, "num"))
    return C.unit_effects(coded, "target_look", UNIT_TERMS, [unit])


@query("I9", sql("aligned", _unit_sql("workerid")))
def worker_effects(spark, sf):
    """Condition, size and time effects of every worker; NULL where a worker's samples cannot tell one."""
    return rounded(_unit_effects(spark, sf, "workerid"), 5)


@query("I9", sql("aligned", _unit_sql("Noun")))
def item_effects(spark, sf):
    """The same per noun."""
    return rounded(_unit_effects(spark, sf, "Noun"), 5)


@query(
    "I9",
    sql(
        "aligned",
        f"""SELECT 'workerid' AS unit, term, {r('avg(estimate)', 4)} AS mean_slope, {r('stddev_samp(estimate)', 4)} AS sd_slope,
            count(estimate) AS n_units FROM ({solve_sql.ols(_UNIT_ROWS, 'target_look', UNIT_TERMS, ['workerid'])}) GROUP BY term
        UNION ALL SELECT 'Noun', term, {r('avg(estimate)', 4)}, {r('stddev_samp(estimate)', 4)}, count(estimate)
            FROM ({solve_sql.ols(_UNIT_ROWS, 'target_look', UNIT_TERMS, ['Noun'])}) GROUP BY term""",
    ),
)
def effects_over_units(spark, sf):
    """Mean and spread of the workers' and of the nouns' own effects, the second stage."""
    parts = [
        C.slope_summary(_unit_effects(spark, sf, unit).withColumnRenamed("estimate", "slope"), ["term"]).withColumn(
            "unit", F.lit(unit)
        )
        for unit in ("workerid", "Noun")
    ]
    return rounded(parts[0].unionByName(parts[1]), 4)


@query(
    "I9",
    sql(
        "aligned",
        f"""SELECT condition, {r('avg(slope)')} AS mean_slope, {r('stddev_samp(slope)')} AS sd_slope, count(slope) AS n_units
        FROM (SELECT condition, workerid, CASE WHEN var_pop(td) > 0 THEN regr_slope(target_look, td / 100) END AS slope FROM ({_MODEL_SQL}) GROUP BY ALL) GROUP BY condition""",
    ),
)
def unit_slopes(spark, sf):
    """Slope of target looks over time per worker, summed up per condition."""
    slopes = C.unit_slopes(window_looks(spark, sf), "target_look", "time_100", ["condition", "workerid"])
    return rounded(C.slope_summary(slopes, ["condition"]))
