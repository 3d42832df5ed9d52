"""Queries of projections, filters and string columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe.catalog import standins as S
from gazeframe.catalog.common import r, rounded
from gazeframe.catalog.registry import query
from gazeframe.catalog.standins import sql
from gazeframe.functions import text
from gazeframe.functions.aoi import MAIN_RANGE, in_range
from gazeframe.functions.nulls import one_of_two
from gazeframe.operators import relational as R
from gazeframe.operators.exclusions import accuracy, inaccurate
from gazeframe.operators.explode import explode_parallel
from gazeframe.operators.reshape import melt, melt_parts
from gazeframe.operators.stats import group_means
from gazeframe.plans.choice import final_click_correct, wide_clicks
from gazeframe.plans.gaze import SERIES, classify, locate

# Non-practice trials per worker in the stand-in, so that both sides of the rate occur.
DIVISOR = 8
LEAST = 0.75


def scored_trials(spark, sf):
    return final_click_correct(wide_clicks(S.choice_trials(spark, sf)))


def samples(spark, sf):
    return S.gaze_samples(spark, sf)


def looks(spark, sf):
    return classify(locate(samples(spark, sf)))


@query("B1", sql("choice_trials", "SELECT * EXCLUDE (response_times, instruction3, Prime) FROM choice_trials"))
def dropped_columns(spark, sf):
    return S.choice_trials(spark, sf).drop("response_times", "instruction3", "Prime")


@query("B2", sql("choice_trials", "SELECT workerid, condition, size, response FROM choice_trials"))
def kept_columns(spark, sf):
    return S.choice_trials(spark, sf).select("workerid", "condition", "size", "response")


@query(
    "B3 D6",
    sql("scored_clicks", "SELECT workerid, trial, click4 FROM scored_clicks WHERE selection_correct = 1 AND ExpFiller <> 'Prac'"),
)
def correct_trials(spark, sf):
    """A NULL test drops the row."""
    kept = scored_trials(spark, sf).where((F.col("selection_correct") == 1) & (F.col("ExpFiller") != "Prac"))
    return kept.select("workerid", "trial", "click4")


_RATES = f"""rates AS (
        SELECT workerid, CAST(coalesce(sum(selection_correct), 0) AS BIGINT) AS n,
            coalesce(sum(selection_correct), 0) / {DIVISOR} AS correct
        FROM scored_clicks WHERE ExpFiller <> 'Prac' GROUP BY workerid)"""


def _rates_sql(body: str) -> str:
    head, tail = sql("scored_clicks", "@").rsplit("@", 1)
    return f"{head.rstrip()}, {_RATES}\n{body}{tail}"


def worker_rates(spark, sf):
    return accuracy(scored_trials(spark, sf), scored=F.col("ExpFiller") != "Prac", divisor=DIVISOR)


@query("F6", _rates_sql(f"SELECT workerid, n, {r('correct')} AS correct FROM rates"))
def accuracy_rates(spark, sf):
    """Correct trials per worker over a fixed number; practice does not count."""
    return rounded(worker_rates(spark, sf))


@query(
    "F6",
    sql(
        "scored_clicks",
        f"""SELECT workerid, CAST(coalesce(sum(selection_correct), 0) AS BIGINT) AS n,
            {r(f'coalesce(sum(selection_correct), 0) / {DIVISOR}')} AS correct FROM scored_clicks GROUP BY workerid""",
    ),
)
def accuracy_rates_with_practice(spark, sf):
    return rounded(accuracy(scored_trials(spark, sf), divisor=DIVISOR))


@query("B10", _rates_sql(f"SELECT workerid, n, {r('correct')} AS correct FROM rates WHERE correct < {LEAST}"))
def inaccurate_workers(spark, sf):
    return rounded(inaccurate(worker_rates(spark, sf), LEAST))


@query(
    "B4",
    _rates_sql(
        f"""SELECT workerid, trial, response FROM choice_trials
        WHERE workerid NOT IN (SELECT workerid FROM rates WHERE correct < {LEAST})"""
    ),
)
def trials_of_accurate_workers(spark, sf):
    listed = inaccurate(worker_rates(spark, sf), LEAST).select("workerid")
    return R.exclude(S.choice_trials(spark, sf), listed, "workerid").select("workerid", "trial", "response")


@query("B5", sql("gaze_samples", 'SELECT DISTINCT workerid, camview, "system_windowW", "system_windowH" FROM gaze_samples'))
def distinct_participants(spark, sf):
    return R.distinct_rows(samples(spark, sf), "workerid", "camview", "system_windowW", "system_windowH")


@query("B6", sql("subjects", "SELECT DISTINCT lower(language) AS language FROM subjects"))
def distinct_languages(spark, sf):
    return S.subjects(spark, sf).select(F.lower("language").alias("language")).distinct()


@query(
    "B7",
    sql("gaze_samples", "SELECT workerid, slide_number, webgazer_time, x, y FROM gaze_samples WHERE x > 0 AND x < 1400 AND y > 0 AND y < 800"),
)
def samples_in_range(spark, sf):
    kept = samples(spark, sf).where(in_range(F.col("x"), F.col("y"), 0, 1400, 0, 800))
    return kept.select("workerid", "slide_number", "webgazer_time", "x", "y")


@query("B8", _rates_sql(f"SELECT workerid, n, {r('correct')} AS correct FROM rates ORDER BY n, workerid"))
def workers_by_tally(spark, sf):
    return rounded(worker_rates(spark, sf)).orderBy("n", "workerid")


_LOOK_COLUMNS = ("workerid", "slide_number", "webgazer_time", "look", "ROI")


@query(
    "B9",
    sql(
        "looks",
        'SELECT workerid, slide_number, webgazer_time, look, "ROI" FROM looks WHERE target_look = 1 OR competitor_look = 1 OR center_look = 1',
    ),
)
def looks_at_three_regions(spark, sf):
    return R.with_any_look(looks(spark, sf), ("target", "competitor", "center")).select(*_LOOK_COLUMNS)


@query(
    "B9",
    sql(
        "looks",
        'SELECT workerid, slide_number, webgazer_time, look, "ROI" FROM looks WHERE target_look = 1 OR competitor_look = 1',
    ),
)
def looks_at_two_regions(spark, sf):
    return R.with_any_look(looks(spark, sf), ("target", "competitor")).select(*_LOOK_COLUMNS)


@query(
    "B11",
    """SELECT user_id, CAST(len(attempts) AS INT) AS n_attempts, accuracy
    FROM (SELECT user_id, event_id, list_filter([CAST(value AS INT), CAST(value / 2 AS INT)], lambda a: a < 50) AS attempts,
              CAST(floor(value) AS INT) AS accuracy FROM events)
    WHERE accuracy >= 50""".replace("CAST(value AS INT)", "CAST(floor(value) AS INT)").replace(
        "CAST(value / 2 AS INT)", "CAST(floor(value / 2) AS INT)"
    ),
)
def calibrated_sessions(spark, sf):
    """Sessions that reach the cutoff, with the number of failed attempts before."""
    attempts = F.filter(
        F.array(F.floor("value"), F.floor(F.col("value") / 2)), lambda a: a < R.CALIBRATION_CUTOFF
    )
    sessions = S.table(spark, sf, "events").select(
        "user_id", F.size(attempts).alias("n_attempts"), F.floor("value").cast("int").alias("accuracy")
    )
    return sessions.where(R.calibrated(F.col("accuracy")))


@query("B12", sql("subjects", 'SELECT workerid, "windowW", "windowH" FROM subjects WHERE "windowW" >= 1280 AND "windowH" >= 750'))
def large_enough_windows(spark, sf):
    kept = S.subjects(spark, sf).where(R.large_enough(F.col("windowW"), F.col("windowH")))
    return kept.select("workerid", "windowW", "windowH")


@query(
    "B13",
    sql(
        "choice_trials",
        """SELECT trial, array_to_string(list_filter(string_split(regexp_replace(response, '[\\[\\]'' ]', '', 'g'), ','),
            lambda c: c NOT IN ('AOI5', 'AOI6')), ',') AS accepted
        FROM choice_trials WHERE ExpFiller = 'Prac'""",
    ),
)
def accepted_practice_clicks(spark, sf):
    trials = S.choice_trials(spark, sf).where(F.col("ExpFiller") == "Prac")
    clicks = F.split(F.regexp_replace("response", r"[\[\]' ]", ""), ",")
    return trials.select("trial", F.array_join(R.drop_clicks(clicks), ",").alias("accepted"))


@query("B14", sql("gaze_samples", "SELECT workerid, slide_number, webgazer_time, x, y FROM gaze_samples WHERE x IS NOT NULL AND y IS NOT NULL"))
def predicted_samples(spark, sf):
    columns = ("workerid", "slide_number", "webgazer_time", "x", "y")
    return R.drop_null_predictions(samples(spark, sf)).select(*columns)


@query("C1", sql("choice_trials", "SELECT trial, regexp_replace(response, '[\\[\\]'' ]|AOI', '', 'g') AS response FROM choice_trials"))
def stripped_responses(spark, sf):
    return S.choice_trials(spark, sf).select("trial", text.strip_list_text(F.col("response")).alias("response"))


@query("C2", sql("wide_clicks", "SELECT trial, click1, click2, click3, click4, NULL::VARCHAR AS click5 FROM wide_clicks"))
def split_responses(spark, sf):
    """A fifth name has no part and stays NULL."""
    names = ("click1", "click2", "click3", "click4", "click5")
    parts = text.split_fixed(text.strip_list_text(F.col("response")), names)
    return S.choice_trials(spark, sf).select("trial", *parts)


@query("C3", sql("list_samples", "SELECT workerid, slide_number, webgazer_time, unixtlist, x, y FROM list_samples"))
def exploded_gaze_lists(spark, sf):
    """Four parallel lists, kept as text, to one typed row per sample."""
    lists = S.gaze_lists(spark, sf).select("workerid", "slide_number", *SERIES)
    return explode_parallel(lists, SERIES, sep=",")


@query("C4", sql("subjects", "SELECT workerid, fairprice, TRY_CAST(fairprice AS DOUBLE) AS fair_value FROM subjects"))
def numeric_fair_price(spark, sf):
    number = text.to_number(F.col("fairprice")).alias("fair_value")
    return S.subjects(spark, sf).select("workerid", "fairprice", number)


@query("C5", "SELECT doc_id, string_split(text, ' ')[-1] AS last_word FROM documents")
def last_words(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", text.last_word(F.col("text")).alias("last_word"))


@query("C6", sql("subjects", "SELECT workerid, lower(language) AS language, lower(comments) AS comments FROM subjects"))
def lower_case(spark, sf):
    return S.subjects(spark, sf).select("workerid", F.lower("language").alias("language"), F.lower("comments").alias("comments"))


@query(
    "C7",
    sql(
        "gaze_samples onsets",
        "SELECT concat_ws(' ', Noun, Name) AS item, count(*) AS n FROM gaze_samples LEFT JOIN onsets ON audio = Prime GROUP BY item",
    ),
)
def item_keys(spark, sf):
    joined = R.left_join_renamed(samples(spark, sf), S.onsets(spark, sf), "audio", "Prime")
    return joined.groupBy(text.item_key(F.col("Noun"), F.col("Name")).alias("item")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C8 H2",
    sql(
        "looks",
        f"""SELECT condition, unnest(['target', 'competitor', 'center']) AS region,
            unnest([{r('avg(target_look)')}, {r('avg(competitor_look)')}, {r('avg(center_look)')}]) AS proportion
        FROM looks GROUP BY condition""",
    ),
)
def name_parts(spark, sf):
    """Wide means to rows; the region is the second part of the column's name."""
    flags = ["target_look", "competitor_look", "center_look"]
    wide = group_means(looks(spark, sf), ["condition"], flags)
    values = [f"mean_{flag}" for flag in flags]
    return rounded(melt_parts(wide, ["condition"], values, "region", "proportion", 2))


_STEPS = """SELECT conv_id, turn, CAST(s AS INT) AS step,
        concat(array_to_string(string_split(text, ' ')[1:k], ' '), CASE s WHEN 4 THEN '.' ELSE ' ...' END) AS shown
    FROM {}, (VALUES (1, 3), (2, 6), (3, 9), (4, 10)) AS steps(s, k)"""


@query("C9", _STEPS.format("conversations"))
def incremental_prefixes(spark, sf):
    """First words of every text at the four steps of a trial."""
    steps = text.incremental_prefixes(F.col("text"))
    return S.table(spark, sf, "conversations").select("conv_id", "turn", F.inline(steps))
