"""Queries of derived columns, classification and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe.catalog import standins as S
from gazeframe.catalog.common import r, rounded
from gazeframe.catalog.registry import query
from gazeframe.catalog.rows import looks, samples, scored_trials
from gazeframe.catalog.standins import sql
from gazeframe.functions import aoi, scores, timebins
from gazeframe.operators import alignment
from gazeframe.operators.calibration import calibration_accuracy
from gazeframe.operators.coding import centre, dummies, interactions, with_alphabetical_code
from gazeframe.operators.lookup import lookup_box, lookup_cell, lookup_interval, lookup_window
from gazeframe.operators.proportions import region_counts
from gazeframe.operators.reshape import melt_measures
from gazeframe.operators.stats import counts
from gazeframe.plans import belief, choice, gaze

SAMPLE = ("workerid", "slide_number", "webgazer_time", "unixtlist")


def with_onsets(spark, sf):
    return gaze.add_onsets(looks(spark, sf), S.onsets(spark, sf))


def aligned(spark, sf, **options):
    return gaze.aligned_looks(with_onsets(spark, sf), **options)


def binned(spark, sf, **options):
    return gaze.binned_looks(with_onsets(spark, sf), **options)


def long_clicks(spark, sf):
    wide = scored_trials(spark, sf).where(F.col("ExpFiller") == "Exp")
    keep = ("trial", "workerid", "condition", "size", "determiner", "item")
    return choice.long_clicks(wide, keep)


def tracked(spark, sf):
    return belief.tracked(S.tracker(spark, sf)).withColumns(belief.gaze_flags())


@query(
    "D1",
    sql("looks", "SELECT DISTINCT target1, target2, target_location, competitor1, competitor2, competitor_location FROM looks"),
)
def quadrants(spark, sf):
    located = gaze.locate(samples(spark, sf))
    return located.select(
        "target1", "target2", "target_location", "competitor1", "competitor2", "competitor_location"
    ).distinct()


_BOXES = {
    "topleft": ("mx - 640", "mx - 363", "my - 375", "my - 125"),
    "bottomleft": ("mx - 640", "mx - 363", "my + 125", "my + 375"),
    "topright": ("mx + 363", "mx + 640", "my - 375", "my - 125"),
    "bottomright": ("mx + 363", "mx + 640", "my + 125", "my + 375"),
    "center": ("mx - 110", "mx + 110", "my - 55", "my + 55"),
}
_BOX_ROWS = " UNION ALL ".join(
    f"SELECT \"system_windowW\", \"system_windowH\", '{name}' AS box, {b[0]} AS x_min, {b[1]} AS x_max, {b[2]} AS y_min, {b[3]} AS y_max FROM m"
    for name, b in _BOXES.items()
)
_BOX_SQL = sql(
    "gaze_samples",
    f"""SELECT * FROM (WITH m AS (SELECT DISTINCT "system_windowW", "system_windowH", "system_windowW" / 2 AS mx,
        "system_windowH" / 2 AS my FROM gaze_samples) {_BOX_ROWS})""",
)


def box_table(spark, sf):
    windows = samples(spark, sf).select("system_windowW", "system_windowH").distinct()
    boxes = aoi.Layout().boxes(F.col("system_windowW"), F.col("system_windowH"))
    rows = [
        F.struct(F.lit(n).alias("box"), *[c.alias(s) for c, s in zip(b, ("x_min", "x_max", "y_min", "y_max"))])
        for n, b in boxes.items()
    ]
    return windows.select("system_windowW", "system_windowH", F.inline(F.array(*rows)))


@query("D2", _BOX_SQL)
def aoi_boxes(spark, sf):
    """Five rectangles per browser window size."""
    return box_table(spark, sf)


@query("D3", sql("looks", "SELECT workerid, slide_number, webgazer_time, unixtlist, look FROM looks"))
def classified_looks(spark, sf):
    return looks(spark, sf).select(*SAMPLE, "look")


@query(
    "D2 D3",
    sql(
        "gaze_samples",
        """SELECT look, count(*) AS n FROM (
            SELECT CASE WHEN x > mx - 640 AND x < mx - 383 AND y > my + 155 AND y < my + 375 THEN 'topleft'
                WHEN x > mx - 640 AND x < mx - 383 AND y > my - 375 AND y < my - 155 THEN 'bottomleft'
                WHEN x > mx + 383 AND x < mx + 640 AND y > my + 155 AND y < my + 375 THEN 'topright'
                WHEN x > mx + 383 AND x < mx + 640 AND y > my - 375 AND y < my - 155 THEN 'bottomright'
                WHEN x > mx - 130 AND x < mx + 130 AND y > my - 65 AND y < my + 65 THEN 'center' ELSE 'other' END AS look
            FROM (SELECT *, "system_windowW" / 2 AS mx, "system_windowH" / 2 AS my FROM gaze_samples)
            WHERE x > -2000 AND x < 3000 AND y > -2000 AND y < 2000) GROUP BY look""",
    ),
)
def snapshot_layout_looks(spark, sf):
    """The earlier snapshot's paddings, y growing upwards."""
    from dataclasses import replace

    layout = replace(aoi.SNAPSHOT_LAYOUT, y_down=False)
    classified = gaze.classify(gaze.locate(samples(spark, sf)), layout, bounds=aoi.WIDE_RANGE)
    return counts(classified, "look")


@query("D4", sql("looks", 'SELECT workerid, slide_number, webgazer_time, unixtlist, look, target_location, "ROI" FROM looks'))
def look_roles(spark, sf):
    return looks(spark, sf).select(*SAMPLE, "look", "target_location", "ROI")


_FLAGS = "target_look, competitor_look, center_look, other_look"


@query("D5", sql("looks", f"SELECT workerid, slide_number, webgazer_time, unixtlist, {_FLAGS} FROM looks"))
def role_flags(spark, sf):
    return looks(spark, sf).select(*SAMPLE, *_FLAGS.split(", "))


@query("D5", sql("looks", f"SELECT workerid, slide_number, webgazer_time, unixtlist, {_FLAGS} FROM looks"))
def role_flags_swapped(spark, sf):
    """Boxes flipped and roles swapped back: the same flags as the upright boxes."""
    flipped = gaze.classify(gaze.locate(samples(spark, sf)), aoi.Layout(y_down=False), swap=True)
    return flipped.select(*SAMPLE, *_FLAGS.split(", "))


@query("D6", sql("scored_clicks", "SELECT trial, CAST(selection_correct AS INT) AS selection_correct FROM scored_clicks"))
def selection_correct(spark, sf):
    """1, 0, or NULL where a practice trial has no second answer."""
    return scored_trials(spark, sf).select("trial", "selection_correct")


@query("D7", sql("long_clicks", "SELECT trial, click_number, target_look, competitor_look, distractor_look FROM long_clicks"))
def click_flags(spark, sf):
    return long_clicks(spark, sf).select(
        "trial", "click_number", "target_look", "competitor_look", "distractor_look"
    )


@query(
    "D8",
    sql("tracked", "SELECT event_id, targetlook, distractorlook, targetdistractorlook, competitordistractorlook FROM tracked"),
)
def tracker_flags(spark, sf):
    return tracked(spark, sf).select(
        "event_id", "targetlook", "distractorlook", "targetdistractorlook", "competitordistractorlook"
    )


_SINCE = [f"time_rel_{o}_onset" for o in timebins.ONSETS]


@query("D9 E2", sql("aligned", f"SELECT workerid, slide_number, webgazer_time, unixtlist, relative_time, {', '.join(_SINCE)} FROM aligned"))
def onset_alignment(spark, sf):
    """Time since five word onsets, from the first classified sample of the trial."""
    return aligned(spark, sf).select(*SAMPLE, "relative_time", *_SINCE)


@query(
    "D9",
    sql(
        "looks onsets",
        """SELECT workerid, slide_number, webgazer_time, unixtlist,
            webgazer_time - first_raw - 1000 - gender_onset_ms_200shift AS time_rel_gender_onset,
            webgazer_time - first_raw - 1000 - name_onset_ms_200shift AS time_rel_name_onset
        FROM (SELECT *, min(webgazer_time) OVER (PARTITION BY workerid, slide_number) AS first_raw FROM looks)
            LEFT JOIN onsets ON audio = Prime WHERE look <> 'other'""",
    ),
)
def onset_alignment_raw_shifted(spark, sf):
    """From the first sample of all, to the onsets shifted by 200 ms."""
    return aligned(spark, sf, origin="raw", shift=200).select(
        *SAMPLE, "time_rel_gender_onset", "time_rel_name_onset"
    )


@query(
    "D9",
    sql(
        "aligned",
        f"""SELECT workerid, slide_number, webgazer_time, unixtlist, {r('webgazer_time - first_sample - 1000 - name_onset_ms / 1000 * 1000')} AS time_rel_name_onset,
            {r('webgazer_time - first_sample - 1000 - gender_onset_ms')} AS time_rel_gender_onset FROM aligned""",
    ),
)
def onset_alignment_seconds(spark, sf):
    """Name onsets kept in seconds, as in one pilot."""
    seconds = with_onsets(spark, sf).withColumn("name_onset_ms", F.col("name_onset_ms") / 1000)
    seen = seconds.where(F.col("look") != "other")
    shifted = alignment.align(alignment.with_first_sample(seen), units={"name": 1000}, onsets=("gender", "name"))
    return rounded(shifted.select(*SAMPLE, "time_rel_name_onset", "time_rel_gender_onset"))


@query("D10", sql("binned", "SELECT workerid, slide_number, webgazer_time, unixtlist, binned_time_relative FROM binned"))
def time_bins(spark, sf):
    found = binned(spark, sf)
    return found.select(*SAMPLE, F.col("binned_time_relative").cast("double").alias("binned_time_relative"))


@query(
    "D10",
    sql(
        "aligned",
        """SELECT CAST(floor(time_rel_gender_onset / 60) * 60 AS DOUBLE) AS time_bin, count(*) AS n FROM aligned
        WHERE time_rel_gender_onset > -600 AND time_rel_gender_onset < 5000 GROUP BY 1""",
    ),
)
def time_bins_pilot(spark, sf):
    """60 ms bins between open bounds."""
    found = alignment.bin_time(
        aligned(spark, sf), "time_rel_gender_onset", 60, -600, 5000, low_open=True, out="time_bin"
    )
    return found.groupBy(F.col("time_bin").cast("double").alias("time_bin")).agg(F.count(F.lit(1)).alias("n"))


_WINDOW_CASE = """CASE WHEN time_rel_click_onset < 0 THEN 'preview' WHEN time_rel_gender_onset < 0 THEN 'baseline'
    WHEN time_rel_determiner_onset < 0 THEN 'gender' WHEN time_rel_name_onset < 0 THEN 'determiner'
    WHEN time_rel_noun_onset < 0 THEN 'name' ELSE 'noun' END"""


@query(
    "D9",
    sql("aligned", "SELECT workerid, slide_number, webgazer_time, unixtlist, relative_time, unixtlist - first_unix AS relative_time_unix FROM aligned"),
)
def relative_unix_times(spark, sf):
    """Milliseconds since the first sample by both of a sample's clocks."""
    return aligned(spark, sf).select(*SAMPLE, "relative_time", "relative_time_unix")


@query("D11", sql("aligned", f'SELECT workerid, slide_number, webgazer_time, unixtlist, {_WINDOW_CASE} AS "window" FROM aligned'))
def window_labels(spark, sf):
    return alignment.label_windows(aligned(spark, sf)).select(*SAMPLE, "window")


@query("E7", sql("aligned", f'SELECT workerid, slide_number, webgazer_time, unixtlist, {_WINDOW_CASE} AS "window" FROM aligned'))
def window_lookup(spark, sf):
    """The same labels from a long onset table with one row per audio and window."""
    onset_of = {"baseline": "click", "gender": "gender", "determiner": "determiner", "name": "name", "noun": "noun"}
    entries = [
        F.struct(F.lit(w).alias("window"), F.col(f"{o}_onset_ms").alias("onset_ms")) for w, o in onset_of.items()
    ]
    long = S.onsets(spark, sf).select(F.col("Prime").alias("audio"), F.inline(F.array(*entries)))
    seen = looks(spark, sf).where(F.col("look") != "other")
    timed = alignment.with_first_sample(seen).withColumn(
        "since_preview", F.col("webgazer_time") - F.col("first_sample") - timebins.PREVIEW_MS
    )
    return lookup_window(timed, long, ["audio"], list(onset_of), "since_preview").select(*SAMPLE, "window")


@query(
    "E7",
    """SELECT s.event_id, i.event_id AS interval FROM (
        SELECT *, epoch_us(ts) AS t FROM events WHERE event_id % 3 <> 0) s
    ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_id % 3 = 0 GROUP BY user_id, epoch_us(ts)) i
        ON s.user_id = i.user_id AND s.t >= i.t""",
)
def interval_lookup(spark, sf):
    """Events in stretches that begin at every third event of their user: any number of intervals per key."""
    events = S.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    starts = events.where("event_id % 3 = 0").select("user_id", F.col("t").alias("start"), F.col("event_id").alias("name"))
    found = lookup_interval(events.where("event_id % 3 <> 0"), starts, ["user_id"], "t", "start", "name")
    return found.select("event_id", "interval")


_BOXES_OF = """SELECT p_partkey AS box, p_size % 5 AS layout, p_partkey * 37 % 1500 - 100.0 AS x_min, p_partkey * 53 % 900 - 50.0 AS y_min,
    CASE WHEN p_partkey % 500 = 7 THEN 5000.0 ELSE 10.0 + p_partkey % 90 END AS side FROM part"""


@query(
    "E8",
    sql(
        "gaze_samples",
        f"""SELECT workerid, slide_number, webgazer_time, unixtlist, min(box) AS look
        FROM (SELECT row_number() OVER () AS id, * FROM gaze_samples) s LEFT JOIN (
            SELECT box, layout, CAST(x_min AS DOUBLE) AS x_min, CAST(y_min AS DOUBLE) AS y_min, CAST(side AS DOUBLE) AS side FROM ({_BOXES_OF})) b
            ON s.workerid % 5 = b.layout AND s.x > x_min AND s.x < x_min + side AND s.y > y_min AND s.y < y_min + side
        GROUP BY id, workerid, slide_number, webgazer_time, unixtlist""",
    ),
)
def cell_lookup(spark, sf):
    """Samples in any number of overlapping boxes per layout, some wider than the screen."""
    S.table(spark, sf, "part").createOrReplaceTempView("_parts")
    boxes = spark.sql(_BOXES_OF.replace("FROM part", "FROM _parts"))
    sides = {c: F.col(c).cast("double") for c in ("x_min", "y_min", "side")}
    ends = {"x_max": F.col("x_min") + F.col("side"), "y_max": F.col("y_min") + F.col("side")}
    gaze_ = S.gaze_samples(spark, sf).withColumn("layout", F.col("workerid") % 5)
    found = lookup_cell(gaze_, boxes.withColumns(sides).withColumns(ends), ["layout"], cell=64)
    return found.select(*SAMPLE, "look")


@query("E8", sql("looks", "SELECT workerid, slide_number, webgazer_time, unixtlist, look FROM looks"))
def box_lookup(spark, sf):
    """The same looks from a table of boxes per window size."""
    kept = samples(spark, sf).where(aoi.in_range(F.col("x"), F.col("y"), *aoi.MAIN_RANGE))
    keys = ["system_windowW", "system_windowH"]
    found = lookup_box(kept, box_table(spark, sf), keys, list(_BOXES))
    return found.select(*SAMPLE, "look")


@query(
    "D12",
    sql(
        "tracker",
        """SELECT CASE WHEN determiner IN ('two', 'three') THEN 'number' ELSE determiner END AS determiner,
            CASE whichword WHEN 'determiner' THEN 'determiner+name' WHEN 'name' THEN 'determiner+name' WHEN 'end' THEN 'noun'
                ELSE whichword END AS "window", count(*) AS n
        FROM tracker GROUP BY ALL""",
    ),
)
def recoded_categories(spark, sf):
    recoded = S.tracker(spark, sf).select(
        scores.recode(F.col("determiner"), belief.MERGED_DETERMINERS).alias("determiner"),
        scores.recode(F.col("whichword"), belief.WINDOW_OF_WORD).alias("window"),
    )
    return counts(recoded, "determiner", "window")


@query(
    "D13",
    sql(
        "gaze_samples",
        """SELECT condition, CAST(CASE condition WHEN 'all' THEN 1 WHEN 'some' THEN 2 END AS INT) AS condition_order, count(*) AS n
        FROM gaze_samples GROUP BY condition""",
    ),
)
def ordered_categories(spark, sf):
    """Ordinal of each category; one outside the list has none."""
    order = scores.level_order(F.col("condition"), ("all", "some"))
    return counts(samples(spark, sf), "condition").select("condition", order.alias("condition_order"), "n")


@query("D15", sql("tracker", f"SELECT event_id, {r('time * 15.9 - 1000')} AS ms FROM tracker"))
def sample_times(spark, sf):
    return rounded(S.tracker(spark, sf).select("event_id", timebins.sample_to_ms(F.col("time")).alias("ms")))


@query(
    "D16",
    sql(
        "binned",
        f"""SELECT workerid, condition, {r('ln((p + 1e-8) / (q + 1e-8))')} AS forward,
            {r('ln((q + 1e-8) / (p + 1e-8))')} AS reversed, {r('ln(p / (q + 1e-8) + 1e-8)')} AS outer_rule
        FROM (SELECT workerid, condition, avg(target_look) AS p, avg(competitor_look) AS q FROM binned GROUP BY ALL)""",
    ),
)
def log_ratios(spark, sf):
    """Both signs and both smoothing rules."""
    means = binned(spark, sf).groupBy("workerid", "condition").agg(
        F.avg("target_look").alias("p"), F.avg("competitor_look").alias("q")
    )
    p, q = F.col("p"), F.col("q")
    return rounded(
        means.select(
            "workerid",
            "condition",
            scores.log_ratio(p, q).alias("forward"),
            scores.log_ratio(p, q, reverse=True).alias("reversed"),
            scores.log_ratio_outer(p, q).alias("outer_rule"),
        )
    )


@query(
    "D17",
    sql(
        "tracker",
        f"""SELECT event_id, {r('time - avg(time) OVER ()')} AS ctime,
            {r("(CASE size WHEN 'big' THEN 1 ELSE 2 END) - avg(CASE size WHEN 'big' THEN 1 ELSE 2 END) OVER ()")} AS csize,
            {r("time - avg(time) OVER (PARTITION BY whichword)")} AS ctime_in_window FROM tracker""",
    ),
)
def centred_columns(spark, sf):
    """A number, an alphabetical category code, and a number centred per window."""
    tracker = S.tracker(spark, sf).select("event_id", "time", "size", "whichword")
    coded = with_alphabetical_code(tracker, "size", "size_code")
    both = centre(coded, {"ctime": "time", "csize": "size_code"})
    each = centre(both, {"ctime_in_window": "time"}, ["whichword"])
    return rounded(each.select("event_id", "ctime", "csize", "ctime_in_window"))


@query(
    "D18",
    sql(
        "tracker",
        """SELECT event_id, CAST(condition = 'all' AS INT) AS condition_all, CAST(condition = 'some' AS INT) AS condition_some,
            CAST(condition = 'all' AS INT) * time AS condition_all__time, CAST(condition = 'some' AS INT) * time AS condition_some__time
        FROM tracker""",
    ),
)
def contrast_columns(spark, sf):
    """Treatment contrasts with ``num`` as reference, and their products with time."""
    coded = S.tracker(spark, sf).withColumns(dummies("condition", ("all", "num", "some"), "num"))
    names = ["condition_all", "condition_some"]
    products = interactions(names, ["time"])
    return coded.withColumns(products).select("event_id", *names, *products)


@query(
    "D19",
    """SELECT event_id, round_even(p, 2)::DOUBLE AS p_rounded,
        CASE WHEN p > 0.05 THEN concat('>', regexp_replace(CAST(round_even(p, 2)::DOUBLE AS VARCHAR), '\\.0$', ''))
            WHEN p < 0.0001 THEN '<.0001' WHEN p < 0.001 THEN '<.001' WHEN p < 0.01 THEN '<.01' ELSE '<.05' END AS p_class
    FROM (SELECT event_id, (value / 500) * (value / 500) AS p FROM events)""",
)
def p_value_classes(spark, sf):
    p = (F.col("value") / 500) * (F.col("value") / 500)
    return S.table(spark, sf, "events").select(
        "event_id", F.bround(p, 2).alias("p_rounded"), scores.p_class(p).alias("p_class")
    )


@query(
    "D21",
    """SELECT vec_id AS workerid, CAST(floor(sum(greatest(0, 100 - sqrt(dx * dx + dy * dy) / (h / 2) * 100)) / 50 + 0.5) AS INT) AS accuracy
    FROM (
        SELECT vec_id, 750 + vec_id % 3 * 50 AS h, 1280 / 2 - (floor(CAST(e AS DOUBLE) * 2000) + 640) AS dx,
            (750 + vec_id % 3 * 50) / 2 - (floor(CAST(b AS DOUBLE) * 2000) + 375) AS dy
        FROM (SELECT vec_id, unnest(embedding) AS e, unnest(list_reverse(embedding)) AS b, unnest(range(64)) AS i FROM embeddings)
        WHERE i < 50
    ) GROUP BY vec_id""",
)
def calibration_scores(spark, sf):
    """Accuracy over the first 50 predictions of every worker."""
    vectors = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("workerid"),
        F.lit(1280).alias("windowW"),
        (F.lit(750) + F.col("vec_id") % 3 * 50).alias("windowH"),
        F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))).alias("point_no", "_p"),
    )
    points = vectors.select(
        "workerid",
        "windowW",
        "windowH",
        "point_no",
        (F.floor(F.col("_p.a").cast("double") * 2000) + 640).alias("x"),
        (F.floor(F.col("_p.b").cast("double") * 2000) + 375).alias("y"),
    )
    return calibration_accuracy(points)


@query(
    "E2 F14",
    sql(
        "looks",
        """SELECT workerid, slide_number, min(webgazer_time) AS first_sample, min(unixtlist) AS first_unix
        FROM looks WHERE look <> 'other' GROUP BY workerid, slide_number""",
    ),
)
def first_samples(spark, sf):
    return alignment.first_samples(looks(spark, sf).where(F.col("look") != "other"))


@query(
    "E3",
    sql(
        "long_clicks tracked",
        f"""SELECT s.determiner, s.size, s."window", s.item, {r('mean_selection')} AS mean_selection, {r('mean_look')} AS mean_look
        FROM (SELECT determiner, size, CASE click_number WHEN 'click1' THEN 'baseline' WHEN 'click2' THEN 'gender'
                WHEN 'click3' THEN 'determiner+name' ELSE 'noun' END AS "window", item, avg(target_look) AS mean_selection
              FROM long_clicks GROUP BY ALL) s
        JOIN (SELECT determiner, size, "window", item, avg(targetlook) AS mean_look FROM tracked GROUP BY ALL) l
            USING (determiner, size, "window", item)""",
    ),
)
def selections_with_looks(spark, sf):
    """Two item-level aggregates joined on four keys."""
    clicks = long_clicks(spark, sf).withColumn("window", scores.recode(F.col("click_number"), choice.WINDOW_OF_CLICK))
    selections = belief.item_means(clicks, {"mean_selection": "target_look"})
    gazes = belief.item_means(tracked(spark, sf), {"mean_look": "targetlook"})
    return rounded(selections.join(gazes, list(belief.GRAIN)))


@query(
    "E4",
    sql(
        "binned",
        f"""WITH a AS (SELECT condition, CAST(binned_time_relative AS DOUBLE) AS bin, 'target' AS region, avg(target_look) AS proportion FROM binned GROUP BY ALL),
            b AS (SELECT condition, size, CAST(binned_time_relative AS DOUBLE) AS bin, 'target' AS region, avg(target_look) AS by_size FROM binned GROUP BY ALL)
        SELECT b.condition, b.size, b.bin, b.region, {r('by_size')} AS by_size, {r('proportion')} AS proportion
        FROM b LEFT JOIN a ON a.condition = b.condition AND a.bin = b.bin AND a.region = b.region""".replace("WITH a AS", "SELECT * FROM (WITH a AS") + ")",
    ),
)
def joined_long_tables(spark, sf):
    """Left join of two long tables on three keys, both from the same counts."""
    found = binned(spark, sf).withColumn("bin", F.col("binned_time_relative").cast("double"))
    counted = region_counts(found, ["condition", "size", "bin"], ("target",)).withColumn("region", F.lit("target"))
    k, n = F.col("k_target"), F.col("n_target")
    keys = ["condition", "bin", "region"]
    fine = counted.select("condition", "size", "bin", "region", (k / n).alias("by_size"))
    coarse = counted.groupBy(*keys).agg((F.sum(k) / F.sum(n)).alias("proportion"))
    return rounded(fine.join(coarse, keys, "left").select("condition", "size", "bin", "region", "by_size", "proportion"))


@query(
    "E5",
    sql(
        "choice_trials subjects",
        """SELECT t.workerid, t.minutes, age, language, education
        FROM (SELECT DISTINCT workerid, trial % 40 / 2 AS minutes FROM choice_trials) t LEFT JOIN subjects s ON t.workerid = s.workerid""",
    ),
)
def trials_with_subjects(spark, sf):
    times = S.choice_trials(spark, sf).select("workerid", (F.col("trial") % 40 / 2).alias("minutes")).distinct()
    subjects = S.subjects(spark, sf).select("workerid", "age", "language", "education")
    return times.join(subjects, "workerid", "left")


@query(
    "H3 D20",
    sql(
        "binned",
        f"""SELECT condition, CAST(binned_time_relative AS DOUBLE) AS bin, unnest(['target', 'competitor', 'center']) AS region,
            unnest([{r('avg(target_look)')}, {r('avg(competitor_look)')}, {r('avg(center_look)')}]) AS proportion,
            unnest([{r('avg(target_look) - stddev_samp(target_look)')}, {r('avg(competitor_look) - stddev_samp(competitor_look)')}, {r('avg(center_look) - stddev_samp(center_look)')}]) AS ymin,
            unnest([{r('avg(target_look) + stddev_samp(target_look)')}, {r('avg(competitor_look) + stddev_samp(competitor_look)')}, {r('avg(center_look) + stddev_samp(center_look)')}]) AS ymax
        FROM binned GROUP BY condition, binned_time_relative""",
    ),
)
def interval_bands(spark, sf):
    """Proportion, lower and upper bound per region, melted in one pass."""
    regions = ("target", "competitor", "center")
    means = [F.avg(f"{g}_look").alias(f"{g}_prop") for g in regions]
    spreads = [F.stddev_samp(f"{g}_look").alias(f"{g}_sd") for g in regions]
    keys = ["condition", F.col("binned_time_relative").cast("double").alias("bin")]
    wide = binned(spark, sf).groupBy(*keys).agg(*means, *spreads)
    for region in regions:
        low, high = scores.band(F.col(f"{region}_prop"), F.col(f"{region}_sd"), F.col(f"{region}_sd"))
        wide = wide.withColumns({f"{region}_ymin": low, f"{region}_ymax": high})
    measures = {"proportion": "{}_prop", "ymin": "{}_ymin", "ymax": "{}_ymax"}
    return rounded(melt_measures(wide, ["condition", "bin"], regions, measures))


@query(
    "H4",
    sql(
        "long_clicks",
        f"""SELECT condition, size, click_number, unnest(['target', 'competitor']) AS "Region",
            unnest([{r('avg(target_look)')}, {r('avg(competitor_look)')}]) AS "Mean",
            unnest([{r('stddev_samp(target_look)')}, {r('stddev_samp(competitor_look)')}]) AS spread
        FROM long_clicks GROUP BY condition, size, click_number""",
    ),
)
def matched_spreads(spark, sf):
    """Two melted means, each with its own spread."""
    regions = ("target", "competitor")
    wide = long_clicks(spark, sf).groupBy("condition", "size", "click_number").agg(
        *[F.avg(f"{g}_look").alias(f"m_{g}") for g in regions],
        *[F.stddev_samp(f"{g}_look").alias(f"sd_{g}") for g in regions],
    )
    long = melt_measures(wide, ["condition", "size", "click_number"], regions, {"Mean": "m_{}", "spread": "sd_{}"}, "Region")
    return rounded(long)
