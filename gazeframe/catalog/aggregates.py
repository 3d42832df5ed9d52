"""Queries of aggregations: counts, proportions, scores, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe.catalog import standins as S
from gazeframe.catalog.common import r, rounded
from gazeframe.catalog.derived import aligned, binned, long_clicks, tracked, with_onsets
from gazeframe.catalog.registry import query
from gazeframe.catalog.rows import DIVISOR, LEAST, scored_trials
from gazeframe.catalog.standins import sql
from gazeframe.functions import scores
from gazeframe.functions.aoi import Layout
from gazeframe.operators import bootstrap, exclusions, proportions, stats
from gazeframe.operators.alignment import bin_time, mean_onsets
from gazeframe.operators.ranking import number_within
from gazeframe.operators.reshape import melt_measures
from gazeframe.plans import belief, choice, gaze

_REGIONS = "['target', 'competitor', 'center']"


def _bin():
    return F.col("binned_time_relative").cast("double").alias("bin")


def _long_proportions(found, keys, regions):
    """Melted proportions with the bin as a double."""
    wide = found.withColumn("binned_time_relative", F.col("binned_time_relative").cast("double"))
    names = {"binned_time_relative": "bin"}
    long = melt_measures(wide, keys, regions, {"proportion": "{}_prop"})
    return rounded(long.withColumnsRenamed(names))


def _proportion_sql(view, keys, regions, where="TRUE", bin_name="bin") -> str:
    names = [k for k in keys if k != "bin"]
    columns = [f'"{n}"' for n in names] + (["CAST(binned_time_relative AS DOUBLE) AS bin"] if "bin" in keys else [])
    group = [f'"{n}"' for n in names] + (["binned_time_relative"] if "bin" in keys else [])
    labels = ", ".join(f"'{g}'" for g in regions)
    means = ", ".join(r(f"avg({g}_look)") for g in regions)
    return sql(
        view,
        f"SELECT {', '.join(columns)}, unnest([{labels}]) AS region, unnest([{means}]) AS proportion "
        f"FROM {view} WHERE {where} GROUP BY {', '.join(group)}",
    )


_ALL = ("target", "competitor", "center")
_TWO = ("target", "competitor")
_ANY_ALL = "(target_look = 1 OR competitor_look = 1 OR center_look = 1)"
_ANY_TWO = "(target_look = 1 OR competitor_look = 1)"


@query("F9 H3", _proportion_sql("binned", ("condition", "size", "bin"), _ALL, _ANY_ALL))
def look_proportions_condition_size(spark, sf):
    """Proportion of looks by condition, size, time bin and region."""
    keys = ["condition", "size", "binned_time_relative"]
    found = proportions.look_proportions(binned(spark, sf), keys, _ALL, _ALL)
    return _long_proportions(found, keys, _ALL)


@query("F9", _proportion_sql("binned", ("condition", "bin"), _ALL, _ANY_ALL))
def look_proportions_condition(spark, sf):
    keys = ["condition", "binned_time_relative"]
    found = proportions.look_proportions(binned(spark, sf), keys, _ALL, _ALL)
    return _long_proportions(found, keys, _ALL)


@query("F9 B9", _proportion_sql("binned", ("condition", "bin"), _TWO, _ANY_TWO))
def look_proportions_two_regions(spark, sf):
    """The same cells over target and competitor looks only: another denominator."""
    keys = ["condition", "binned_time_relative"]
    found = proportions.look_proportions(binned(spark, sf), keys, _TWO, _TWO)
    return _long_proportions(found, keys, _TWO)


@query("F9 B9", _proportion_sql("binned", ("condition", "size", "bin"), _TWO))
def look_proportions_unrestricted(spark, sf):
    """Over all looks kept, whatever region they fall in."""
    keys = ["condition", "size", "binned_time_relative"]
    return _long_proportions(proportions.look_proportions(binned(spark, sf), keys, _TWO), keys, _TWO)


@query("F9", _proportion_sql("binned", ("condition", "camview", "size", "bin"), _TWO, _ANY_TWO))
def look_proportions_camera(spark, sf):
    """Apart for workers whose camera view blocked a region."""
    keys = ["condition", "camview", "size", "binned_time_relative"]
    found = proportions.look_proportions(binned(spark, sf), keys, _TWO, _TWO)
    return _long_proportions(found, keys, _TWO)


@query(
    "F9",
    sql(
        "binned",
        f"""SELECT key_set, condition, size, camview, CAST(binned_time_relative AS DOUBLE) AS bin, n, {r('tp')} AS target_prop, {r('cp')} AS competitor_prop
        FROM (
            SELECT 'condition,binned_time_relative' AS key_set, condition, NULL AS size, NULL AS camview, binned_time_relative,
                count(*) AS n, avg(target_look) AS tp, avg(competitor_look) AS cp FROM binned WHERE {_ANY_TWO} GROUP BY condition, binned_time_relative
            UNION ALL SELECT 'condition,camview,binned_time_relative', condition, NULL, camview, binned_time_relative,
                count(*), avg(target_look), avg(competitor_look) FROM binned WHERE {_ANY_TWO} GROUP BY condition, camview, binned_time_relative
            UNION ALL SELECT 'condition,camview,size,binned_time_relative', condition, size, camview, binned_time_relative,
                count(*), avg(target_look), avg(competitor_look) FROM binned WHERE {_ANY_TWO} GROUP BY condition, camview, size, binned_time_relative
        )""",
    ),
)
def look_proportions_by_sets(spark, sf):
    """Three key sets with one denominator rule, from one pass over the samples."""
    sets = [
        ["condition", "binned_time_relative"],
        ["condition", "camview", "binned_time_relative"],
        ["condition", "camview", "size", "binned_time_relative"],
    ]
    found = proportions.proportions_by_sets(binned(spark, sf), sets, _TWO, _TWO)
    return rounded(
        found.select("key_set", "condition", "size", "camview", _bin(), "n", "target_prop", "competitor_prop")
    )


@query(
    "F9",
    sql(
        "tracked",
        f"""SELECT time, condition, size, {r('avg(targetlook)')} AS target_prop, {r('avg(competitorlook)')} AS competitor_prop,
            {r('avg(residuelook)')} AS residue_prop
        FROM tracked WHERE time < 300 AND (targetlook = 1 OR competitorlook = 1 OR residuelook = 1) GROUP BY time, condition, size""",
    ),
)
def tracker_proportions(spark, sf):
    """Looks of the external tracker per sample index."""
    regions = ("target", "competitor", "residue")
    kept = belief.tracked(S.tracker(spark, sf)).where(F.col("time") < 300)
    keys = ["time", "condition", "size"]
    found = proportions.look_proportions(kept, keys, regions, regions, suffix="look")
    return rounded(found.select(*keys, *[f"{g}_prop" for g in regions]))


@query(
    "C3 D3 D9 D10 F9 F14 H3",
    _proportion_sql("list_binned", ("condition", "size", "bin"), _ALL, _ANY_ALL),
)
def look_proportions_from_lists(spark, sf):
    """From list-shaped trials: origins are found inside each trial's row."""
    trials = gaze.add_onsets(gaze.locate(S.gaze_lists(spark, sf)), S.onsets(spark, sf))
    looks = gaze.looks_from_lists(trials)
    keys = ["condition", "size", "binned_time_relative"]
    found = proportions.look_proportions(gaze.binned_looks(looks), keys, _ALL, _ALL)
    return _long_proportions(found, keys, _ALL)


_KEPT = f"""kept AS (SELECT * FROM scored_clicks WHERE workerid NOT IN (
        SELECT workerid FROM scored_clicks WHERE ExpFiller <> 'Prac' GROUP BY workerid
        HAVING coalesce(sum(selection_correct), 0) / {DIVISOR} < {LEAST}))"""

_STUDY = """study AS (
        SELECT *, CAST(response = CAST(target1 AS VARCHAR) OR response = CAST(target2 AS VARCHAR) AS INT) AS ok FROM gaze_lists),
    kept AS (
        SELECT slide_number FROM study WHERE ok = 1 AND trial_type = 'Exp' AND workerid NOT IN (
            SELECT workerid FROM study WHERE trial_type <> 'Prac' GROUP BY workerid HAVING sum(ok) / 20 < 0.9))"""


@query(
    "A2 B4 C3 D6 E1 F8 F9 H3",
    sql("list_binned", "@").replace(
        "\n@",
        f""",\n{_STUDY}
        SELECT condition, size, camview, CAST(binned_time_relative AS DOUBLE) AS bin, unnest({_REGIONS}) AS region,
            unnest([{r('avg(target_look)')}, {r('avg(competitor_look)')}, {r('avg(center_look)')}]) AS proportion
        FROM list_binned WHERE slide_number IN (SELECT slide_number FROM kept) AND {_ANY_ALL}
        GROUP BY condition, size, camview, binned_time_relative""",
    ),
)
def gaze_study(spark, sf):
    """The whole gaze study: trial rows, exclusions, samples, looks, bins, proportions."""
    trials = gaze.prepare_trials(S.gaze_lists(spark, sf), S.onsets(spark, sf))
    kept = gaze.analysed_trials(trials, least=0.9, divisor=20)
    keys = ["condition", "size", "camview", "binned_time_relative"]
    looks = gaze.binned_looks(gaze.looks_from_lists(kept))
    return _long_proportions(proportions.look_proportions(looks, keys, _ALL, _ALL), keys, _ALL)


@query(
    "B4 F8 F11 H1",
    sql("scored_clicks", "@").replace(
        "\n@",
        f""",\n{_KEPT},
        experimental_clicks AS (SELECT * FROM kept WHERE selection_correct = 1 AND ExpFiller = 'Exp'),
        long_clicks AS ({S.VIEWS["long_clicks"][0]})
        SELECT condition, size, click_number, {r('avg(target_look)')} AS target_prop, {r('avg(competitor_look)')} AS competitor_prop
        FROM long_clicks GROUP BY ALL""",
    ),
)
def choice_study(spark, sf):
    """The whole choice study: response lists, exclusions, clicks, proportions."""
    wide = choice.wide_clicks(S.choice_trials(spark, sf))
    kept = choice.analysed_trials(wide, least=LEAST, divisor=DIVISOR)
    keys = ["condition", "size", "click_number"]
    clicks = choice.long_clicks(kept, ["condition", "size"])
    found = proportions.look_proportions(clicks, keys, _TWO)
    return rounded(found.select(*keys, "target_prop", "competitor_prop"))


@query("F10 D20")
def look_proportions_with_intervals(spark, sf):
    """Proportions with a 95% bootstrap band of 1000 resamples per cell."""
    keys = ["condition", "size", "binned_time_relative"]
    found = proportions.look_proportions(binned(spark, sf), keys, _ALL, _ALL)
    banded = bootstrap.binomial_intervals(found, keys, {g: (f"k_{g}", f"n_{g}") for g in _ALL})
    for region in _ALL:
        low, high = scores.band(
            F.col(f"{region}_prop"), F.col(f"{region}_CILow"), F.col(f"{region}_CIHigh")
        )
        banded = banded.withColumns({f"{region}_ymin": low, f"{region}_ymax": high})
    measures = {"proportion": "{}_prop", "ymin": "{}_ymin", "ymax": "{}_ymax"}
    return melt_measures(banded, keys, _ALL, measures)


_WEIGHT = " + ".join(
    f"CAST(u >= {cut} AS INT)" for cut in ("0.36787944", "0.73575888", "0.91969860", "0.98101184", "0.99634015")
)


@query(
    "F10",
    f"""SELECT event_type, CAST(b AS INT) AS replicate, {r('sum(w * value) / sum(w)')} AS boot_mean
    FROM (
        SELECT event_type, value, b, {_WEIGHT} AS w
        FROM (
            SELECT event_type, value, b,
                ('0x' || substr(md5(concat(event_id, ':', b // 4)), CAST(b % 4 * 8 + 1 AS INT), 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM events, range(48) AS t(b)
        )
    ) GROUP BY event_type, b""",
)
def digest_bootstrap(spark, sf):
    """48 Poisson replicates whose weights come from md5 digests."""
    events = S.table(spark, sf, "events")
    return rounded(bootstrap.digest_bootstrap(events, ["event_type"], "value", "event_id", 48))


@query("F1", sql("scored_clicks", "SELECT CAST(selection_correct AS INT) AS selection_correct, count(*) AS n FROM scored_clicks WHERE selection_correct IS NOT NULL GROUP BY selection_correct"))
def value_counts(spark, sf):
    """NULL selections are not counted."""
    return stats.counts(scored_trials(spark, sf), "selection_correct")


@query(
    "F2",
    sql(
        "choice_trials",
        "SELECT condition, count(*) FILTER (size = 'big') AS big, count(*) FILTER (size = 'small') AS small FROM choice_trials GROUP BY condition",
    ),
)
def cross_table(spark, sf):
    return stats.cross_table(S.choice_trials(spark, sf), "condition", "size", ["big", "small"])


@query("F3", sql("subjects", f"SELECT camblock, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share FROM subjects GROUP BY camblock"))
def shares_of_total(spark, sf):
    return rounded(stats.shares(S.subjects(spark, sf), "camblock"))


def _six_sql(value: str) -> str:
    parts = {"min_value": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max_value": 1}
    return ", ".join(f"{r(f'quantile_cont({value}, {p})')} AS {n}" for n, p in parts.items()) + f", {r(f'avg({value})')} AS mean"


@query("F4", sql("subjects", f"SELECT {_six_sql('time_in_minutes')} FROM subjects"))
def six_number_summary(spark, sf):
    return rounded(stats.six_numbers(S.subjects(spark, sf), "time_in_minutes"))


@query("F4", f"SELECT event_type, {_six_sql('value')} FROM events GROUP BY event_type")
def six_number_summary_by_rank(spark, sf):
    """The same numbers per group, with groups cut into many ranges."""
    events = S.table(spark, sf, "events")
    return rounded(stats.six_numbers(events, "value", ["event_type"], parts=64))


@query("F5", sql("subjects", f"SELECT {r('avg(accuracy)')} AS mean, {r('stddev_samp(accuracy)')} AS sd FROM subjects"))
def mean_and_sd(spark, sf):
    return rounded(stats.mean_sd(S.subjects(spark, sf), "accuracy"))


@query(
    "F7",
    sql(
        "subjects",
        f"SELECT eyesight, eyesight_task, {r('avg(accuracy)')} AS mean_accuracy, {r('avg(time_in_minutes)')} AS mean_time_in_minutes FROM subjects GROUP BY ALL",
    ),
)
def subject_means(spark, sf):
    found = stats.group_means(S.subjects(spark, sf), ["eyesight", "eyesight_task"], ["accuracy", "time_in_minutes"])
    return rounded(found)


@query("F7 F10")
def subject_means_with_intervals(spark, sf):
    """Mean accuracy per eyesight group with a resampled band."""
    found = bootstrap.bootstrap_mean(S.subjects(spark, sf), ["eyesight", "eyesight_task"], "accuracy")
    low, high = scores.band(F.col("mean"), F.col("CILow"), F.col("CIHigh"))
    return found.select("eyesight", "eyesight_task", "n", "mean", low.alias("YMin"), high.alias("YMax"))


_FUNNEL = f"""SELECT stage_no, stage, rows_left, workers_left, {r("rows_left / max(CASE WHEN stage_no = 1 THEN rows_left END) OVER ()")} AS share_left
    FROM (
        SELECT 1 AS stage_no, 'loaded' AS stage, count(*) AS rows_left, count(DISTINCT workerid) AS workers_left FROM scored_clicks
        UNION ALL SELECT 2, 'accurate_workers', count(*), count(DISTINCT workerid) FROM kept
        UNION ALL SELECT 3, 'correct_trials', count(*), count(DISTINCT workerid) FROM kept WHERE selection_correct = 1
        UNION ALL SELECT 4, 'wanted_trials', count(*), count(DISTINCT workerid) FROM kept WHERE selection_correct = 1 AND ExpFiller = 'Exp'
    )"""



@query("F8", sql("scored_clicks", "@").replace("\n@", f",\n{_KEPT}\n{_FUNNEL}"))
def exclusion_funnel(spark, sf):
    """Rows and workers left after each exclusion, from one pass."""
    found = exclusions.exclusion_funnel(
        scored_trials(spark, sf),
        scored=F.col("ExpFiller") != "Prac",
        wanted=F.col("ExpFiller") == "Exp",
        least=LEAST,
        divisor=DIVISOR,
    )
    return rounded(found)


@query("F8 B4", sql("scored_clicks", "@").replace("\n@", f",\n{_KEPT}\nSELECT workerid, trial FROM kept WHERE selection_correct = 1 AND ExpFiller = 'Exp'"))
def trials_after_exclusions(spark, sf):
    kept = exclusions.apply_exclusions(
        scored_trials(spark, sf),
        scored=F.col("ExpFiller") != "Prac",
        wanted=F.col("ExpFiller") == "Exp",
        least=LEAST,
        divisor=DIVISOR,
    )
    return kept.select("workerid", "trial")


def _selection_sql(keys: str, where: str = "TRUE") -> str:
    return sql(
        "long_clicks",
        f"""SELECT {keys}, unnest(['target', 'competitor']) AS region, unnest([{r('avg(target_look)')}, {r('avg(competitor_look)')}]) AS proportion
        FROM long_clicks WHERE {where} GROUP BY {keys}""",
    )


@query("F11", _selection_sql("condition, size, click_number"))
def selection_proportions(spark, sf):
    keys = ["condition", "size", "click_number"]
    found = proportions.look_proportions(long_clicks(spark, sf), keys, _TWO)
    return rounded(melt_measures(found, keys, _TWO, {"proportion": "{}_prop"}))


@query("F11 B9", _selection_sql("condition, size, click_number", _ANY_TWO))
def selection_proportions_two_regions(spark, sf):
    keys = ["condition", "size", "click_number"]
    found = proportions.look_proportions(long_clicks(spark, sf), keys, _TWO, _TWO)
    return rounded(melt_measures(found, keys, _TWO, {"proportion": "{}_prop"}))


def _clicks_by_half(spark, sf):
    numbered = number_within(scored_trials(spark, sf), ["workerid"], ["trial"])
    halves = numbered.withColumn("trial_group", F.when(F.col("trial_number") < 6, "first").otherwise("second"))
    return choice.long_clicks(halves.where(F.col("ExpFiller") == "Exp"), ["condition", "size", "trial_group"])


@query(
    "F11 D14 G1",
    sql(
        "long_clicks",
        f"""SELECT condition, size, click_number, trial_group, {r('avg(target_look)')} AS target_prop, {r('avg(competitor_look)')} AS competitor_prop
        FROM long_clicks JOIN (
            SELECT trial, CASE WHEN row_number() OVER (PARTITION BY workerid ORDER BY trial) < 6 THEN 'first' ELSE 'second' END AS trial_group
            FROM choice_trials) USING (trial)
        GROUP BY ALL""",
    ),
)
def selection_proportions_by_half(spark, sf):
    """By half of a worker's log; the stand-in has about ten trials per worker."""
    keys = ["condition", "size", "click_number", "trial_group"]
    found = proportions.look_proportions(_clicks_by_half(spark, sf), keys, _TWO)
    return rounded(found.select(*keys, "target_prop", "competitor_prop"))


@query("F11 F10")
def selection_proportions_with_intervals(spark, sf):
    keys = ["condition", "size", "click_number"]
    found = proportions.look_proportions(long_clicks(spark, sf), keys, _TWO)
    banded = bootstrap.binomial_intervals(found, keys, {g: (f"k_{g}", f"n_{g}") for g in _TWO})
    measures = {"Mean": "{}_prop", "CILow": "{}_CILow", "CIHigh": "{}_CIHigh"}
    long = melt_measures(banded, keys, _TWO, measures, "Region")
    low, high = scores.band(F.col("Mean"), F.col("CILow"), F.col("CIHigh"))
    return long.select(*keys, "Region", "Mean", low.alias("YMin"), high.alias("YMax"))


@query(
    "F12 D16",
    sql(
        "binned",
        f"""SELECT condition, CAST(binned_time_relative AS DOUBLE) AS bin, {r('avg(s)')} AS mean_score, count(*) AS n_units
        FROM (SELECT condition, workerid, binned_time_relative, ln((avg(target_look) + 1e-8) / (avg(competitor_look) + 1e-8)) AS s
              FROM binned WHERE {_ANY_TWO} GROUP BY condition, workerid, binned_time_relative)
        GROUP BY condition, binned_time_relative""",
    ),
)
def target_scores(spark, sf):
    """Mean over workers of each worker's log ratio per condition and bin."""
    found = proportions.two_stage_score(
        _two_region_looks(spark, sf), ["workerid"], ["condition", "bin"], F.col("target_look"), F.col("competitor_look")
    )
    return rounded(proportions.score_means(found, ["condition", "bin"]))


def _two_region_looks(spark, sf):
    from gazeframe.operators.relational import with_any_look

    return with_any_look(binned(spark, sf), _TWO).withColumn("bin", F.col("binned_time_relative").cast("double"))


@query(
    "F12",
    sql(
        "long_clicks",
        f"""SELECT condition, size, click_number, {r('avg(s)')} AS mean_score, count(*) AS n_units
        FROM (SELECT condition, size, click_number, workerid, ln(avg(target_look) / (avg(competitor_look) + 1e-8) + 1e-8) AS s
              FROM long_clicks WHERE {_ANY_TWO} GROUP BY ALL)
        GROUP BY ALL""",
    ),
)
def selection_scores(spark, sf):
    """The same for selections, by the other smoothing rule."""
    from gazeframe.operators.relational import with_any_look

    cell = ["condition", "size", "click_number"]
    found = proportions.two_stage_score(
        with_any_look(long_clicks(spark, sf), _TWO), ["workerid"], cell, F.col("target_look"), F.col("competitor_look"), rule="outer"
    )
    return rounded(proportions.score_means(found, cell))


@query("F12 F10")
def target_scores_with_intervals(spark, sf):
    """Mean scores with a resampled band over workers."""
    cell = ["condition", "bin"]
    found = proportions.two_stage_score(
        _two_region_looks(spark, sf), ["workerid"], cell, F.col("target_look"), F.col("competitor_look")
    )
    means = bootstrap.bootstrap_mean(found, cell, "score")
    low, high = scores.band(F.col("mean"), F.col("CILow"), F.col("CIHigh"))
    return means.select(*cell, "n", "mean", low.alias("ymin"), high.alias("ymax"))


@query(
    "F13",
    sql(
        "binned",
        f"""SELECT condition, size, CAST(binned_time_relative AS DOUBLE) AS bin, {r('ln((avg(competitor_look) + 1e-8) / (avg(target_look) + 1e-8))')} AS score
        FROM binned WHERE {_ANY_TWO} GROUP BY condition, size, binned_time_relative""",
    ),
)
def one_stage_scores(spark, sf):
    """Log ratio of cell means, with the reversed sign."""
    cell = ["condition", "size", "bin"]
    return rounded(
        proportions.one_stage_score(
            _two_region_looks(spark, sf), cell, F.col("target_look"), F.col("competitor_look"), reverse=True
        )
    )


@query(
    "F15",
    sql(
        "binned",
        f"""SELECT {r('avg(gender_onset_ms) - 1000')} AS gender, {r('avg(determiner_onset_ms) - 1000')} AS determiner,
            {r('avg(name_onset_ms) - 1000')} AS name, {r('avg(noun_onset_ms) - 1000')} AS noun FROM binned""",
    ),
)
def mean_word_onsets(spark, sf):
    words = ("gender", "determiner", "name", "noun")
    return rounded(mean_onsets(binned(spark, sf), {w: f"{w}_onset_ms" for w in words}))


@query(
    "F15 D15",
    sql("tracker", f"SELECT {r('avg(gender_onset) * 15.9 - 1000')} AS gender, {r('avg(noun_onset) * 15.9 - 1000')} AS noun FROM tracker"),
)
def mean_tracker_onsets(spark, sf):
    return rounded(mean_onsets(S.tracker(spark, sf), {"gender": "gender_onset", "noun": "noun_onset"}, 15.9))


@query(
    "F16",
    sql(
        "tracker",
        f"""SELECT whichword, {r('min(time)')} AS min_value, {r('avg(time)')} AS mean, {r('median(time)')} AS median, {r('max(time)')} AS max_value
        FROM tracker GROUP BY whichword""",
    ),
)
def window_time_ranges(spark, sf):
    return rounded(stats.time_ranges(S.tracker(spark, sf), ["whichword"], "time"))


@query("F17", sql("tracked", "SELECT count(*) AS n_combinations FROM (SELECT DISTINCT determiner, size, item FROM tracked)"))
def distinct_combinations(spark, sf):
    return stats.distinct_combinations(belief.tracked(S.tracker(spark, sf)), "determiner", "size", "item")


_LOOK_MEANS = ("targetlook", "competitorlook", "distractorlook", "targetdistractorlook", "competitordistractorlook")


@query(
    "F18",
    sql(
        "tracked",
        f"""SELECT determiner, size, "window", item, {', '.join(f"{r(f'avg({c})')} AS mean_{c}" for c in _LOOK_MEANS)}
        FROM tracked GROUP BY ALL""",
    ),
)
def item_look_means(spark, sf):
    found = belief.item_means(tracked(spark, sf), {f"mean_{c}": c for c in _LOOK_MEANS})
    return rounded(found)


@query(
    "F18",
    sql(
        "long_clicks",
        f"""SELECT determiner, size, item, click_number, {r('avg(target_look)')} AS target, {r('avg(competitor_look)')} AS competitor,
            {r('avg(distractor_look)')} AS distractor FROM long_clicks GROUP BY ALL""",
    ),
)
def item_selection_means(spark, sf):
    keys = ("determiner", "size", "item", "click_number")
    flags = {g: f"{g}_look" for g in ("target", "competitor", "distractor")}
    return rounded(belief.item_means(long_clicks(spark, sf), flags, keys))


@query(
    "F19",
    sql(
        "belief",
        f"""SELECT "window", "Region", determiner, size, {r('avg(prop_selections)')} AS prop_selections, {r('avg(prop_looks)')} AS prop_looks
        FROM belief GROUP BY ALL""",
    ),
)
def means_over_items(spark, sf):
    """Item-level means averaged again over items."""
    return rounded(collapsed(spark, sf))


def belief_rows(spark, sf):
    """Selections and looks per item cell and region."""
    clicks = long_clicks(spark, sf).withColumn("window", scores.recode(F.col("click_number"), choice.WINDOW_OF_CLICK))
    selections = belief.item_means(clicks, {f"Mean_{g}_selection": f"{g}_look" for g in belief.REGIONS})
    gazes = belief.item_means(tracked(spark, sf), {f"Mean_{g}_look": f"{g}look" for g in belief.REGIONS})
    return belief.compare(selections, gazes)


def collapsed(spark, sf):
    keys = ["window", "Region", "determiner", "size"]
    found = belief_rows(spark, sf)
    return found.groupBy(*keys).agg(
        F.avg("prop_selections").alias("prop_selections"), F.avg("prop_looks").alias("prop_looks")
    )


@query(
    "F20",
    "SELECT floor((value - 0) / 20) * 20 + 0.0::DOUBLE AS bin_start, count(*) AS n FROM events GROUP BY 1",
)
def histogram_bins(spark, sf):
    """Rows per bin of width 20."""
    return stats.histogram(S.table(spark, sf, "events"), "value", 0, 20)


@query("F20 F1", sql("subjects", "SELECT language, eyesight, count(*) AS n FROM subjects GROUP BY ALL"))
def histogram_categories(spark, sf):
    return stats.counts(S.subjects(spark, sf), "language", "eyesight")


@query(
    "F1 D11",
    sql(
        "aligned",
        """SELECT "window", target_look, count(*) AS n FROM (
            SELECT *, CASE WHEN time_rel_click_onset < 0 THEN 'preview' WHEN time_rel_gender_onset < 0 THEN 'baseline'
                WHEN time_rel_determiner_onset < 0 THEN 'gender' WHEN time_rel_name_onset < 0 THEN 'determiner'
                WHEN time_rel_noun_onset < 0 THEN 'name' ELSE 'noun' END AS "window" FROM aligned)
        GROUP BY ALL""",
    ),
)
def counts_per_window(spark, sf):
    from gazeframe.operators.alignment import label_windows

    return stats.counts(label_windows(aligned(spark, sf)), "window", "target_look")


@query(
    "D5 F9",
    sql("binned", f"SELECT condition, {r('avg(target_look)')} AS target_prop, {r('avg(competitor_look)')} AS competitor_prop FROM binned GROUP BY condition"),
)
def proportions_compatible_mode(spark, sf):
    """Flipped boxes with swapped roles give the proportions of the upright boxes."""
    flipped = gaze.classify(gaze.locate(S.gaze_samples(spark, sf)), Layout(y_down=False), swap=True)
    found = bin_time(gaze.aligned_looks(gaze.add_onsets(flipped, S.onsets(spark, sf))))
    counted = proportions.look_proportions(found, ["condition"], _TWO)
    return rounded(counted.select("condition", "target_prop", "competitor_prop"))


def _limits(found, keys, regions):
    """Proportions with the limits of their bootstrap bands, one row per key and region."""
    banded = bootstrap.binomial_intervals(found, keys, {g: (f"k_{g}", f"n_{g}") for g in regions}, resamples=None)
    measures = {"n": "n_{}", "proportion": "{}_prop", "low": "{}_CILow", "high": "{}_CIHigh"}
    long = melt_measures(banded, keys, regions, measures)
    ymin, ymax = scores.band(F.col("proportion"), F.col("low"), F.col("high"))
    named = [F.col(k).cast("double").alias(k) if k == "binned_time_relative" else F.col(k) for k in keys]
    return rounded(long.select(*named, "region", "n", "proportion", ymin.alias("ymin"), ymax.alias("ymax")))


def _limits_sql(view, keys, regions, where="TRUE", suffix="_look", source=None) -> str:
    """The same by adding up the binomial law of every cell until a tail is reached."""
    head = ", ".join(f'"{k}"' for k in keys)
    cells = " UNION ALL ".join(
        f"""SELECT {head}, '{g}' AS region, count({g}{suffix}) AS n, CAST(sum({g}{suffix}) AS BIGINT) AS k
            FROM {source or view} WHERE {where} GROUP BY {head}"""
        for g in regions
    )
    chance = """CASE WHEN k = 0 THEN CAST(i = 0 AS INT) WHEN k = n THEN CAST(i = n AS INT)
        ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(k / n) + (n - i) * ln(1 - k / n)) END"""
    law = f"""(SELECT *, sum({chance}) OVER (PARTITION BY {head}, region ORDER BY i) AS c
        FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM ({cells})))"""
    return sql(
        view,
        f"""SELECT {head}, region, n, {r('k / n')} AS proportion, {r('min(i) FILTER (c >= 0.025) / n')} AS ymin,
            {r('min(i) FILTER (c >= 0.975) / n')} AS ymax FROM {law} GROUP BY {head}, region, n, k""",
    )


_BIN_KEYS = ("condition", "size", "binned_time_relative")


@query("F10 D20 F9", _limits_sql("binned", _BIN_KEYS, _ALL, _ANY_ALL))
def look_proportions_with_limits(spark, sf):
    """Bands that ever more resamples tend to: binomial quantiles."""
    return _limits(proportions.look_proportions(binned(spark, sf), list(_BIN_KEYS), _ALL, _ALL), list(_BIN_KEYS), _ALL)


@query("F10 D20 F9 B9", _limits_sql("binned", ("condition", "binned_time_relative"), _TWO, _ANY_TWO))
def look_proportions_two_regions_with_limits(spark, sf):
    """Looks at target and competitor per condition and bin, with bands."""
    keys = ["condition", "binned_time_relative"]
    return _limits(proportions.look_proportions(binned(spark, sf), keys, _TWO, _TWO), keys, _TWO)


@query("F10 D20 F9 B9", _limits_sql("binned", ("condition", "camview", "binned_time_relative"), _ALL, _ANY_TWO))
def look_proportions_camera_with_limits(spark, sf):
    """All regions by whether the camera view covered one, with bands."""
    keys = ["condition", "camview", "binned_time_relative"]
    return _limits(proportions.look_proportions(binned(spark, sf), keys, _ALL, _TWO), keys, _ALL)


_TRACKED_THREE = ("target", "competitor", "residue")


@query(
    "F10 D20 F9 B9",
    _limits_sql(
        "tracker", ("condition", "size", "time"), _TRACKED_THREE, "(targetlook = 1 OR competitorlook = 1 OR residuelook = 1)", "look"
    ),
)
def tracker_proportions_with_limits(spark, sf):
    """Tracker looks per sample index at target, competitor and residue, with bands."""
    keys = ["condition", "size", "time"]
    found = proportions.look_proportions(S.tracker(spark, sf), keys, _TRACKED_THREE, _TRACKED_THREE, "look")
    return _limits(found, keys, _TRACKED_THREE)


@query("F10 D20 F9 B9", _limits_sql("tracker", ("condition", "size", "time"), _TWO, "(targetlook = 1 OR competitorlook = 1)", "look"))
def tracker_proportions_two_regions_with_limits(spark, sf):
    """The same at target and competitor alone."""
    keys = ["condition", "size", "time"]
    return _limits(proportions.look_proportions(S.tracker(spark, sf), keys, _TWO, _TWO, "look"), keys, _TWO)


@query("F11 F10 D20", _limits_sql("long_clicks", ("condition", "size", "click_number"), _TWO))
def selection_proportions_with_limits(spark, sf):
    """Selections per condition, size and step, with bands."""
    keys = ["condition", "size", "click_number"]
    return _limits(proportions.look_proportions(long_clicks(spark, sf), keys, _TWO), keys, _TWO)


@query(
    "F11 F10 D14 D20 G1",
    _limits_sql(
        "long_clicks",
        ("condition", "size", "click_number", "trial_group"),
        _TWO,
        source="""(SELECT * FROM long_clicks JOIN (
            SELECT trial, CASE WHEN row_number() OVER (PARTITION BY workerid ORDER BY trial) < 6 THEN 'first' ELSE 'second' END AS trial_group
            FROM choice_trials) USING (trial))""",
    ),
)
def selection_proportions_by_half_with_limits(spark, sf):
    """Selections by half of a worker's log, with bands."""
    keys = ["condition", "size", "click_number", "trial_group"]
    return _limits(proportions.look_proportions(_clicks_by_half(spark, sf), keys, _TWO), keys, _TWO)
