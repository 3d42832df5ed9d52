"""Queries of sources, sinks and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeframe.catalog import standins as S
from gazeframe.catalog.registry import query
from gazeframe.catalog.standins import sql
from gazeframe.operators.explode import explode_parallel
from gazeframe.operators.relational import left_join_renamed
from gazeframe.session import work_dir
from gazeframe.sources import schemas
from gazeframe.sources.files import csv_lines, read_csv, read_onsets, write_csv
from gazeframe.sources.merge import merge_sources, stack
from gazeframe.sources.stimuli import (
    read_practice,
    read_stimuli,
    tidy_practice,
    tidy_stimuli,
    to_records,
)
from gazeframe.sources.submissions import flatten_submissions, parse_submissions

_CSV_SUBJECT = T.StructType(
    [
        f
        for f in schemas.SUBJECT
        if f.name in ("fairprice", "gender", "age", "workerid", "language", "comments", "education", "enjoyment")
    ]
)
_CSV_NAMES = ", ".join(_CSV_SUBJECT.names)


@query("A1 A6", sql("subjects", f"SELECT {_CSV_NAMES} FROM subjects"))
def csv_round_trip(spark, sf):
    """Subject table written as CSV and read back by its declared schema."""
    folder = work_dir(spark, "subjects-csv")
    write_csv(S.subjects(spark, sf).select(*_CSV_SUBJECT.names), folder)
    return read_csv(spark, folder, _CSV_SUBJECT)


@query(
    "A6",
    sql("subjects", "SELECT concat(workerid, ',', coalesce(CAST(age AS VARCHAR), 'NA'), ',', language) AS line FROM subjects"),
)
def csv_text_lines(spark, sf):
    return csv_lines(S.subjects(spark, sf).select("workerid", "age", "language"))


@query(
    "A2 E1",
    sql(
        "gaze_samples onsets",
        """SELECT Noun, count(*) AS n, CAST(sum(click_onset_ms) AS DOUBLE) AS sum_click,
            CAST(sum(noun_onset_ms_200shift) AS DOUBLE) AS sum_noun
        FROM gaze_samples LEFT JOIN onsets ON audio = Prime GROUP BY Noun""",
    ),
)
def onset_dimension(spark, sf):
    """Onset table loaded by its declared schema and joined to every sample."""
    folder = work_dir(spark, "onsets")
    S.onsets(spark, sf).write.parquet(folder)
    onsets = read_onsets(spark, folder, schemas.ONSETS)
    joined = left_join_renamed(S.gaze_samples(spark, sf), onsets, "audio", "Prime")
    return joined.groupBy("Noun").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("click_onset_ms").alias("sum_click"),
        F.sum("noun_onset_ms_200shift").alias("sum_noun"),
    )


_SUBMISSION = (
    "trials array<struct<slide_number: bigint, trial_type: string, condition: string, response: string, trial_start: bigint>>,"
    "system struct<Browser: string, windowW: int, windowH: int>, condition string,"
    "subject_information struct<age: int, accuracy: int, camblock: string>, time_in_minutes double"
)


def _submissions(spark, sf):
    """One nested JSON submission of two trials per order."""
    trials = S.choice_trials(spark, sf)

    def trial(step):
        return F.struct(
            (F.col("trial") * 2 + step).alias("slide_number"),
            F.col("ExpFiller").alias("trial_type"),
            F.concat("condition", F.lit(str(step))).alias("condition"),
            F.get(F.split(F.regexp_replace("response", r"[\[\]' ]", ""), ","), F.lit(step)).alias("response"),
            (F.lit(1600000000000) + F.col("trial") * 1000 + step).alias("trial_start"),
        )

    return trials.select(
        "workerid",
        F.to_json(
            F.struct(
                F.array(trial(0), trial(1)).alias("trials"),
                F.struct(
                    F.lit("Firefox").alias("Browser"),
                    (F.lit(1280) + F.col("workerid") % 4 * 10).cast("int").alias("windowW"),
                    F.lit(750).alias("windowH"),
                ).alias("system"),
                F.col("condition"),
                F.struct(
                    (F.lit(20) + F.col("workerid") % 50).cast("int").alias("age"),
                    (F.col("trial") % 101).cast("int").alias("accuracy"),
                    F.lit("No").alias("camblock"),
                ).alias("subject_information"),
                (F.col("trial") % 40 / 2).alias("time_in_minutes"),
            )
        ).alias("submission"),
    )


@query(
    "A3",
    sql(
        "choice_trials",
        """SELECT workerid, 'Firefox' AS system_Browser,
            CAST(1280 + workerid % 4 * 10 AS INT) AS system_windowW, 750 AS system_windowH, condition AS submission_condition, concat(condition, step) AS condition,
            CAST(20 + workerid % 50 AS INT) AS subject_information_age,
            CAST(trial % 101 AS INT) AS subject_information_accuracy, 'No' AS subject_information_camblock,
            trial % 40 / 2 AS time_in_minutes, trial * 2 + step AS slide_number, ExpFiller AS trial_type,
            string_split(regexp_replace(response, '[\\[\\]'' ]', '', 'g'), ',')[CAST(step AS INT) + 1] AS response,
            1600000000000 + trial * 1000 + step AS trial_start
        FROM choice_trials, (VALUES (CAST(0 AS BIGINT)), (1)) AS s(step)""",
    ),
)
def nested_submissions(spark, sf):
    """Nested JSON submissions to one flat row per trial."""
    return flatten_submissions(parse_submissions(_submissions(spark, sf), "submission", _SUBMISSION))


@query(
    "A6",
    """SELECT 'c_custkey,name' AS line UNION ALL
    SELECT concat(c_custkey, ',', CASE WHEN c_custkey % 3 = 0 THEN chr(34) || 'a, ' || chr(34) || chr(34) || c_name || chr(34) || chr(34) || chr(34) WHEN c_custkey % 3 = 1 THEN c_name ELSE 'NA' END) FROM customer""",
)
def csv_lines_quoted(spark, sf):
    """CSV text with a header, of cells with separators and quotes in them."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('a, "'), "c_name", F.lit('"'))).when(
        F.col("c_custkey") % 3 == 1, F.col("c_name")
    )
    return csv_lines(S.table(spark, sf, "customer").select("c_custkey", name.alias("name")), header=True)


@query(
    "C3 C1",
    """SELECT o_orderkey, unnest([CAST(o_orderkey AS BIGINT), 2, o_custkey, 7]) AS a,
        unnest([o_orderkey + 0.5, 2.25, CAST(o_custkey AS DOUBLE), NULL]) AS b FROM orders""",
)
def broken_gaze_lists(spark, sf):
    """List text of several brackets, fractions in a whole-number list, and an item that is no number."""
    orders = S.table(spark, sf, "orders").select(
        "o_orderkey",
        F.format_string("[%d, 2.75], [%d.0,7]", F.col("o_orderkey"), F.col("o_custkey")).alias("a"),
        F.format_string("[%d.5, 2.25], [%d, NaT]", F.col("o_orderkey"), F.col("o_custkey")).alias("b"),
    )
    return explode_parallel(orders, {"a": "bigint", "b": "double"}, sep=",")


@query(
    "A4",
    """WITH part1 AS (SELECT c_custkey AS workerid, 'A' AS speaker_cond FROM customer),
        part2 AS (SELECT o_custkey + 1 + (SELECT max(workerid) FROM part1) AS workerid, 'B' AS speaker_cond FROM orders),
        part3 AS (SELECT s_suppkey + 1 + (SELECT max(workerid) FROM part2) AS workerid, 'A' AS speaker_cond FROM supplier)
        SELECT workerid, speaker_cond, count(*) AS n
        FROM (SELECT * FROM part1 UNION ALL SELECT * FROM part2 UNION ALL SELECT * FROM part3)
        GROUP BY workerid, speaker_cond""",
)
def merged_sources(spark, sf):
    """Three result files whose worker ids are shifted apart."""
    sources = [
        (S.table(spark, sf, "customer").select(F.col("c_custkey").alias("workerid")), "A"),
        (S.table(spark, sf, "orders").select(F.col("o_custkey").alias("workerid")), "B"),
        (S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("workerid")), "A"),
    ]
    return merge_sources(sources).groupBy("workerid", "speaker_cond").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A5",
    sql("tracker", "SELECT whichword, TrackLoss, count(*) AS n, CAST(sum(time) AS BIGINT) AS sum_time FROM tracker GROUP BY ALL"),
)
def stacked_exports(spark, sf):
    """One export per window, stacked by column name."""
    tracker = S.tracker(spark, sf)
    words = ("baseline", "gender", "determiner", "name", "end")
    stacked = stack(*[tracker.where(F.col("whichword") == word) for word in words])
    return stacked.groupBy("whichword", "TrackLoss").agg(
        F.count(F.lit(1)).alias("n"), F.sum("time").alias("sum_time")
    )


def _json_sql(view: str, columns, underscored, last: str) -> str:
    cells = []
    for name in columns:
        value = f"replace({name}, ' ', '_')" if name in underscored else name
        if name == last:
            value = f"regexp_replace({value}, '\\s+$', '')"
        cells.append(f"concat('\"{name}\":\"', {value}, '\"')")
    return sql(view, f"SELECT concat('{{', concat_ws(',', {', '.join(cells)}), '}}') AS record FROM {view}")


@query(
    "A7",
    _json_sql("stimuli", schemas.STIMULUS_COLUMNS, schemas.STIMULUS_UNDERSCORED, "instruction3"),
)
def stimulus_records(spark, sf):
    """Stimulus CSV with its misspelt header, to tidy JSON records."""
    folder = work_dir(spark, "stimuli-csv")
    misnamed = S.stimuli(spark, sf).withColumnsRenamed(
        {"display_type": "display type", "location5": "lcoation5", "target_object3": "target object1"}
    )
    misnamed.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return to_records(tidy_stimuli(read_stimuli(spark, folder)))


@query(
    "A8",
    _json_sql("practice", schemas.PRACTICE_COLUMNS, schemas.PRACTICE_UNDERSCORED, "correctAns2"),
)
def practice_records(spark, sf):
    """Practice table with lines that end in CR, to tidy JSON records."""
    folder = work_dir(spark, "practice-csv")
    S.practice(spark, sf).write.option("header", True).option("lineSep", "\r").csv(folder)
    return to_records(tidy_practice(read_practice(spark, folder)))


@query(
    "G1 D14",
    sql(
        "choice_trials",
        """SELECT trial, trial_number, CASE WHEN trial_number < 31 THEN 'first_half' ELSE 'second_half' END AS trial_group
        FROM (SELECT trial, CAST(row_number() OVER (PARTITION BY workerid % 100 ORDER BY trial) AS INT) AS trial_number
              FROM choice_trials)""",
    ),
)
def trial_numbers(spark, sf):
    """Trial number in log order within a worker, and the half it falls in."""
    from gazeframe.functions.timebins import half
    from gazeframe.operators.ranking import number_within

    trials = S.choice_trials(spark, sf).select((F.col("workerid") % 100).alias("worker"), "trial")
    numbered = number_within(trials, ["worker"], ["trial"])
    return numbered.select("trial", "trial_number", half(F.col("trial_number")).alias("trial_group"))


@query(
    "G1",
    """SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS trial_number
    FROM events""",
)
def trial_numbers_hot_workers(spark, sf):
    """The same numbering with workers cut over many ranges."""
    from gazeframe.operators.ranking import number_within

    events = S.table(spark, sf, "events").select("user_id", "event_id")
    return number_within(events, ["user_id"], ["event_id"], parts=64)


@query(
    "G2 H1",
    sql(
        "long_clicks",
        "SELECT trial AS ID, click_number, location FROM long_clicks",
    ),
)
def long_clicks_by_id(spark, sf):
    """Clicks of a trial to rows; the trial key stands for a row id."""
    from gazeframe.operators.reshape import melt
    from gazeframe.plans.choice import CLICKS, wide_clicks

    wide = wide_clicks(S.choice_trials(spark, sf)).where(F.col("ExpFiller") == "Exp")
    named = wide.withColumnRenamed("trial", "ID")
    return melt(named, ["ID"], CLICKS, "click_number", "location")


@query(
    "K1",
    """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey
            ORDER BY md5(concat(o_custkey, ':', o_orderkey, ':s1')), o_orderkey) AS INT) AS presentation,
        CAST(('0x' || substr(md5(concat(o_custkey, ':s1')), 1, 8))::BIGINT % 3 + 1 AS INT) AS list
    FROM orders""",
)
def presentation_order(spark, sf):
    """Seeded random order of each worker's trials, and the worker's list."""
    from gazeframe.operators.ranking import assigned_list, seeded_order

    trials = S.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    ordered = seeded_order(trials, "o_custkey", "o_orderkey", "s1")
    return ordered.select(
        "o_orderkey", "presentation", assigned_list(F.col("o_custkey"), 3, "s1").alias("list")
    )
