"""Study tables derived from the driver tables, in Spark and as SQL views.

No eye-tracking data is supplied, so each study table is computed from a whole
driver table. ``VIEWS`` holds the same derivations for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.operators.relational import settle

# Nouns the stand-in instructions end in.
NOUNS = ("ring", "bolt", "plate", "rod", "gear", "gizmo", "anvil", "widget")
_NOUNS = ", ".join(f"'{noun}'" for noun in NOUNS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _quadrant_numbers(q: str) -> str:
    """AOI numbers of a target in quadrant ``q`` (0-3) and of its competitor."""
    return f"""
        CAST({q} + 1 AS INT) AS target1, CAST({q} + 7 AS INT) AS target2,
        CAST(CASE {q} WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 3 END AS INT) AS competitor1,
        CAST(CASE {q} WHEN 0 THEN 8 WHEN 1 THEN 7 WHEN 2 THEN 10 ELSE 9 END AS INT) AS competitor2"""


_CENTS = "CAST(floor({} * 100 + 0.5) AS BIGINT)"

# One gaze sample per order line. {days} is the day number of the line.
_GAZE_SAMPLES = f"""
    SELECT l_suppkey AS workerid, l_orderkey % 54 AS slide_number,
        {{days}} * 2 + l_linenumber / 4 AS webgazer_time,
        1600000000000 + {{days}} * 2 + l_linenumber AS unixtlist,
        CASE WHEN l_quantity = 13 THEN NULL
             ELSE {_CENTS.format('l_extendedprice')} % 160000 / 100 - 100 END AS x,
        CASE WHEN l_quantity = 13 THEN NULL
             ELSE (l_orderkey * 7919 + l_partkey * 104729) % 90000 / 100 - 50 END AS y,
        CAST(1280 + l_suppkey % 5 * 64 AS INT) AS system_windowW,
        CAST(750 + l_suppkey % 4 * 50 AS INT) AS system_windowH,
        CASE l_returnflag WHEN 'A' THEN 'all' WHEN 'N' THEN 'num' ELSE 'some' END AS condition,
        CASE l_linestatus WHEN 'O' THEN 'big' ELSE 'small' END AS size,
        concat('NATION_', l_partkey % 25) AS audio,
        CASE WHEN l_suppkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS camview,
        {_quadrant_numbers('(l_orderkey % 54 % 4)')}
    FROM {{lineitem}}"""

_ONSETS = """
    SELECT n_name AS Prime, concat('name', n_regionkey) AS Name, concat('noun', n_nationkey % 8) AS Noun,
        {plain}, {shifted}
    FROM {nation}"""
_ONSET_MS = {
    "click": "100 + 10 * n_nationkey",
    "gender": "500 + 10 * n_nationkey + 20 * n_regionkey",
    "determiner": "1100 + 10 * n_nationkey + 20 * n_regionkey",
    "name": "1600 + 10 * n_nationkey + 20 * n_regionkey",
    "noun": "2100 + 10 * n_nationkey + 20 * n_regionkey",
}
_PLAIN = ", ".join(f"CAST({ms} AS DOUBLE) AS {o}_onset_ms" for o, ms in _ONSET_MS.items())
_SHIFTED = ", ".join(
    f"CAST({ms} + 200 AS DOUBLE) AS {o}_onset_ms_200shift" for o, ms in _ONSET_MS.items()
)
_ONSETS = _ONSETS.replace("{plain}", _PLAIN).replace("{shifted}", _SHIFTED)

# One choice trial per order. {div} is integer division, {noun} picks item k of the nouns.
_C = _CENTS.format("o_totalprice")
_CHOICE_TRIALS = f"""
    SELECT workerid, trial, condition, size, ExpFiller, target1, 
        CASE WHEN ExpFiller = 'Prac' THEN NULL ELSE target2 END AS target2,
        competitor1, CASE WHEN ExpFiller = 'Prac' THEN NULL ELSE competitor2 END AS competitor2,
        determiner,
        concat('[''AOI', c {{div}} 10 % 10 + 1, ''', ''AOI', c {{div}} 100 % 10 + 1, ''', ''AOI',
            CASE WHEN c % 2 = 0 THEN q + 1 ELSE c {{div}} 1000 % 10 + 1 END, ''', ''AOI',
            CASE WHEN c % 5 < 4 THEN q + 1 ELSE c {{div}} 7 % 10 + 1 END, ''']') AS response,
        concat('[', c % 900 + 300, ', ', c % 900 + 1500, ', ', c % 900 + 2600, ', ', c % 900 + 3900, ']')
            AS response_times,
        concat('Click on the ', CASE WHEN q < 2 THEN 'boy' ELSE 'girl' END, ' that has ', determiner,
            ' of Susan''s ', noun) AS instruction3,
        concat('Prime', trial % 48) AS Prime
    FROM (
        SELECT o_custkey AS workerid, o_orderkey AS trial, {_C} AS c, {_C} % 4 AS q,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'all' WHEN '2-HIGH' THEN 'some'
                WHEN '3-MEDIUM' THEN 'num' WHEN '4-NOT SPECIFIED' THEN 'one' ELSE 'four' END AS condition,
            CASE WHEN o_orderkey % 2 = 0 THEN 'big' ELSE 'small' END AS size,
            CASE WHEN o_orderkey % 9 = 0 THEN 'Prac'
                WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Exp'
                ELSE 'Filler' END AS ExpFiller,
            CASE WHEN o_orderpriority = '3-MEDIUM' THEN
                    CASE WHEN o_orderkey % 4 < 2 THEN 'two' ELSE 'three' END
                WHEN o_orderpriority = '1-URGENT' THEN 'all' WHEN o_orderpriority = '2-HIGH' THEN 'some'
                WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'one' ELSE 'four' END AS determiner,
            {{noun_of_order}} AS noun,
            {_quadrant_numbers(f'({_C} % 4)').replace('AS INT', 'AS STRING')}
        FROM {{orders}}
    ) AS o"""

# One tracker sample per event. {k} is the number in props, {second} the second of the day.
_TRACKER = """
    SELECT event_id, concat('Prime', k % 48) AS Prime, concat('S', user_id) AS Subject,
        CASE k % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'some' ELSE 'num' END AS condition,
        CASE k % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'some'
            ELSE CASE WHEN event_id % 2 = 0 THEN 'two' ELSE 'three' END END AS determiner,
        CASE WHEN event_id {div} 2 % 2 = 0 THEN 'big' ELSE 'small' END AS size,
        concat('Click on it ', noun) AS instruction, sample AS time,
        CASE WHEN sample < 115 THEN 'baseline' WHEN sample < 171 THEN 'gender'
            WHEN sample < 213 THEN 'determiner' WHEN sample < 245 THEN 'name' ELSE 'end' END AS whichword,
        CASE WHEN event_type = 'error' THEN 'TRUE' ELSE 'FALSE' END AS TrackLoss,
        CASE WHEN value > 200 THEN NULL WHEN event_type = 'click' THEN 1 ELSE 0 END AS targetlook,
        CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS competitorlook,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS residuelook,
        CAST(130 + k % 10 AS DOUBLE) AS gender_onset, CAST(170 + k % 10 AS DOUBLE) AS determiner_onset,
        CAST(212 + k % 7 AS DOUBLE) AS name_onset, CAST(240 + k % 5 AS DOUBLE) AS noun_onset
    FROM (
        SELECT *, CAST({k} AS INT) AS k, CAST(72 + {second} {div} 300 AS INT) AS sample,
            {noun_of_event} AS noun
        FROM {events}
    ) AS e"""

_A = _CENTS.format("c_acctbal")
_SUBJECTS = f"""
    SELECT c_custkey AS workerid,
        CASE WHEN c_custkey % 3 = 0 THEN 'Yes' WHEN c_custkey % 3 = 1 THEN '1.70' ELSE '2' END AS fairprice,
        CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
        CAST(CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE 18 + abs({_A}) % 60 END AS INT) AS age,
        CASE WHEN c_custkey % 4 = 0 THEN 'english' ELSE 'English' END AS language,
        concat('I said "', c_mktsegment, '", twice') AS comments,
        CAST(c_nationkey % 5 AS INT) AS education, CAST(c_custkey % 3 AS INT) AS enjoyment,
        CASE WHEN c_nationkey % 2 = 0 THEN 'normal' ELSE 'glasses' END AS eyesight,
        CASE WHEN c_custkey % 5 = 0 THEN 'glasses' ELSE 'none' END AS eyesight_task,
        CASE WHEN c_custkey % 7 < 3 THEN 'Yes' ELSE 'No' END AS camblock,
        CAST(abs({_A}) % 101 AS INT) AS accuracy,
        (abs({_A}) % 2500 + 500) / 100 AS time_in_minutes,
        CAST(1100 + c_custkey % 7 * 60 AS INT) AS windowW, CAST(650 + c_custkey % 5 * 50 AS INT) AS windowH
    FROM {{customer}}"""

# One stimulus per part.
_STIMULI = """
    SELECT CAST(p_partkey AS STRING) AS displayID, p_type AS setting, 'Susan''s' AS figure,
        '33-33' AS display_type,
        concat('2 ', p_name) AS location1, concat('3 ', p_name) AS location2,
        concat('2 big ', p_name) AS location3, concat('3 big ', p_name) AS location4,
        concat('1 ', p_name) AS location5, '1 pear' AS location6,
        'boy' AS location7, 'boy' AS location8, 'girl' AS location9, 'girl' AS location10,
        concat('Prime', p_partkey) AS Prime,
        CAST(p_partkey % 4 + 1 AS STRING) AS target1, CAST(p_partkey % 4 + 7 AS STRING) AS target2,
        '2' AS competitor1, '8' AS competitor2, 'some' AS condition, 'some' AS determiner,
        'small' AS size, 'Exp' AS ExpFiller, concat('AOI', p_partkey % 4 + 1) AS correctAns1,
        concat('AOI', p_partkey % 4 + 7) AS correctAns2, CAST(p_size % 3 + 1 AS STRING) AS list,
        concat('2 ', p_name) AS target_object3, 'boy' AS target_figure3, p_name AS object3,
        concat('Click on the boy that has some of Susan''s ', p_name, {tail}) AS instruction3
    FROM {part}"""

_PRACTICE = """
    SELECT CAST(p_partkey AS STRING) AS displayID, 'Prac' AS ExpFiller, p_type AS setting,
        'Susan''s' AS figure, p_name AS Intro_object, concat('2 ', p_name) AS Res_object,
        concat('3 ', p_name) AS object1, concat('4 ', p_name) AS object2, '1 red pear' AS object3,
        '1 apple' AS object4, '33-33' AS display_type,
        concat('2 ', p_name) AS location1, concat('3 ', p_name) AS location2, '2 pears' AS location3,
        '3 pears' AS location4, '1 pear' AS location5, '1 apple' AS location6,
        'boy' AS location7, 'boy' AS location8, 'girl' AS location9, 'girl' AS location10,
        'some' AS condition1, 'small' AS size1, CAST(p_partkey % 4 + 1 AS STRING) AS target1,
        '2' AS competitor1, concat('2 ', p_name) AS target_object1, 'boy' AS target_figure1,
        'some' AS determiner1, p_name AS object1_noun,
        concat('Click on the boy with the ', p_name) AS instruction1,
        concat('Prime', p_partkey) AS prime, concat('AOI', p_partkey % 4 + 1) AS correctAns1,
        concat('AOI', p_partkey % 4 + 7) AS correctAns2
    FROM {part}"""


def _pick(key: str, dialect: str) -> str:
    """Noun number ``key % 8`` in either dialect."""
    if dialect == "spark":
        return f"array({_NOUNS})[CAST({key} % 8 AS INT)]"
    return f"([{_NOUNS}])[CAST({key} % 8 AS INT) + 1]"


_SPARK = {
    "days": "datediff(l_shipdate, DATE'1995-01-02')",
    "div": "div",
    "k": "regexp_extract(props, '[0-9]+', 0)",
    "second": "(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT))",
    "noun_of_order": _pick("o_custkey", "spark"),
    "noun_of_event": _pick("user_id", "spark"),
    "tail": "'  '",
}
_DUCK = {
    "days": "date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE))",
    "div": "//",
    "k": "regexp_extract(props, '[0-9]+')",
    "second": "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))",
    "noun_of_order": _pick("o_custkey", "duck"),
    "noun_of_event": _pick("user_id", "duck"),
    "tail": "'  '",
}


def _derive(spark: SparkSession, sf: str, source: str, text: str) -> DataFrame:
    filled = text.replace("{" + source + "}", "{source_table}")
    for name, value in _SPARK.items():
        filled = filled.replace("{" + name + "}", value)
    derived = spark.sql(filled, source_table=table(spark, sf, source))
    # A stored table would hold these columns, so filters must not redo them.
    return settle(derived, {name: F.col(name) for name in derived.columns})


def gaze_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, "lineitem", _GAZE_SAMPLES)


def onsets(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, "nation", _ONSETS)


def choice_trials(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, "orders", _CHOICE_TRIALS)


def tracker(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, "events", _TRACKER)


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, "customer", _SUBJECTS)


def stimuli(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, "part", _STIMULI)


def practice(spark: SparkSession, sf: str) -> DataFrame:
    return _derive(spark, sf, "part", _PRACTICE)


def gaze_lists(spark: SparkSession, sf: str) -> DataFrame:
    """One trial per embedding: its 64 numbers become the samples' coordinates."""

    def text(items):
        joined = F.array_join(F.transform(items, lambda item: item.cast("string")), ", ")
        return F.concat(F.lit("["), joined, F.lit("]"))

    e = F.col("embedding")
    number = F.transform(e, lambda _, i: i * 64)
    vec, q = F.col("vec_id"), F.col("label") % 4
    return table(spark, sf, "embeddings").select(
        (vec % 20).alias("workerid"),
        vec.alias("slide_number"),
        text(number).alias("webgazer_time"),
        text(F.transform(number, lambda ms: ms + 1600000000000 + vec * 10000)).alias("unixtlist"),
        text(F.transform(e, lambda v: F.floor(v.cast("double") * 3000) + 640)).alias("x"),
        text(F.transform(F.reverse(e), lambda v: F.floor(v.cast("double") * 2000) + 375)).alias("y"),
        F.lit(1280).alias("system_windowW"),
        (F.lit(750) + vec % 3 * 50).cast("int").alias("system_windowH"),
        F.element_at(F.array(*map(F.lit, ("all", "some", "num"))), (vec % 3 + 1).cast("int")).alias(
            "condition"
        ),
        F.when(vec % 2 == 0, "big").otherwise("small").alias("size"),
        F.concat(F.lit("NATION_"), (vec % 25).cast("string")).alias("audio"),
        F.when(vec % 9 == 0, "Prac").when(vec % 4 == 3, "Filler").otherwise("Exp").alias("trial_type"),
        (q + F.when(vec % 11 < 9, 1).otherwise(5)).cast("string").alias("response"),
        F.when(vec % 3 == 0, "Yes").otherwise("No").alias("subject_information_camblock"),
        F.lit("English").alias("subject_information_language"),
        (q + 1).cast("int").alias("target1"),
        (q + 7).cast("int").alias("target2"),
        F.element_at(F.array(*map(F.lit, (2, 1, 4, 3))), q + 1).alias("competitor1"),
        F.element_at(F.array(*map(F.lit, (8, 7, 10, 9))), q + 1).alias("competitor2"),
    )


_GAZE_LISTS_SQL = """
    SELECT vec_id % 20 AS workerid, vec_id AS slide_number,
        list_transform(embedding, lambda v, i: (i - 1) * 64) AS times,
        list_transform(embedding, lambda v, i: 1600000000000 + vec_id * 10000 + (i - 1) * 64) AS unixes,
        list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 3000) AS BIGINT) + 640) AS xs,
        list_transform(list_reverse(embedding),
            lambda v: CAST(floor(CAST(v AS DOUBLE) * 2000) AS BIGINT) + 375) AS ys,
        1280 AS system_windowW, CAST(750 + vec_id % 3 * 50 AS INT) AS system_windowH,
        CASE vec_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'some' ELSE 'num' END AS condition,
        CASE WHEN vec_id % 2 = 0 THEN 'big' ELSE 'small' END AS size,
        CASE WHEN vec_id % 9 = 0 THEN 'Prac' WHEN vec_id % 4 = 3 THEN 'Filler' ELSE 'Exp' END AS trial_type,
        CAST(label % 4 + CASE WHEN vec_id % 11 < 9 THEN 1 ELSE 5 END AS VARCHAR) AS response,
        CASE WHEN vec_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS camview,
        concat('NATION_', vec_id % 25) AS audio, """ + _quadrant_numbers("(label % 4)") + """
    FROM embeddings"""

_LIST_SAMPLES_SQL = """
    SELECT * EXCLUDE (times, unixes, xs, ys),
        CAST(unnest(times) AS DOUBLE) AS webgazer_time, unnest(unixes) AS unixtlist,
        CAST(unnest(xs) AS DOUBLE) AS x, CAST(unnest(ys) AS DOUBLE) AS y
    FROM gaze_lists"""

_LOCATION = """CASE WHEN {0}1 = 1 AND {0}2 = 7 THEN 'topleft' WHEN {0}1 = 2 AND {0}2 = 8 THEN 'bottomleft'
        WHEN {0}1 = 3 AND {0}2 = 9 THEN 'topright' WHEN {0}1 = 4 AND {0}2 = 10 THEN 'bottomright' END"""

# Samples of {source} with look, role and flags by the main layout, y growing downwards.
_LOOKS_SQL = f"""
    SELECT *, CAST(ROI = 'target' AS INT) AS target_look, CAST(ROI = 'competitor' AS INT) AS competitor_look,
        CAST(ROI = 'center' AS INT) AS center_look, CAST(ROI = 'other' AS INT) AS other_look
    FROM (
        SELECT *, CASE WHEN look = target_location THEN 'target' WHEN look = competitor_location THEN 'competitor'
            WHEN look = 'center' THEN 'center' ELSE 'other' END AS ROI
        FROM (
            SELECT *, {_LOCATION.format('target')} AS target_location,
                {_LOCATION.format('competitor')} AS competitor_location,
                CASE WHEN x > mx - 640 AND x < mx - 363 AND y > my - 375 AND y < my - 125 THEN 'topleft'
                    WHEN x > mx - 640 AND x < mx - 363 AND y > my + 125 AND y < my + 375 THEN 'bottomleft'
                    WHEN x > mx + 363 AND x < mx + 640 AND y > my - 375 AND y < my - 125 THEN 'topright'
                    WHEN x > mx + 363 AND x < mx + 640 AND y > my + 125 AND y < my + 375 THEN 'bottomright'
                    WHEN x > mx - 110 AND x < mx + 110 AND y > my - 55 AND y < my + 55 THEN 'center'
                    ELSE 'other' END AS look
            FROM (SELECT *, system_windowW / 2 AS mx, system_windowH / 2 AS my FROM {{source}}) AS m
            WHERE x > -1000 AND x < 2280 AND y > -1000 AND y < 1750
        ) AS l
    ) AS r"""

_ALIGNED_SQL = """
    SELECT *, {}
    FROM (
        SELECT l.*, o.* EXCLUDE (Prime),
            min(webgazer_time) OVER (PARTITION BY workerid, slide_number) AS first_sample,
            min(unixtlist) OVER (PARTITION BY workerid, slide_number) AS first_unix
        FROM {{looks}} l LEFT JOIN onsets o ON l.audio = o.Prime WHERE look <> 'other'
    ) AS a"""
_ALIGNED_SQL = _ALIGNED_SQL.format(
    "webgazer_time - first_sample AS relative_time, "
    + ", ".join(
        f"webgazer_time - first_sample - 1000 - {o}_onset_ms AS time_rel_{o}_onset" for o in _ONSET_MS
    )
)

_BINNED_SQL = """
    SELECT *, floor(time_rel_click_onset / 100) * 100 AS binned_time_relative
    FROM {} WHERE time_rel_click_onset >= 0 AND time_rel_click_onset < 4000"""

_SELECTION_SQL = """
    SELECT *, CASE WHEN CAST(click4 AS DOUBLE) = CAST(target1 AS DOUBLE) THEN 1
        WHEN CAST(click4 AS DOUBLE) <> CAST(target1 AS DOUBLE) THEN
            CASE WHEN CAST(click4 AS DOUBLE) = CAST(target2 AS DOUBLE) THEN 1
                 WHEN CAST(click4 AS DOUBLE) <> CAST(target2 AS DOUBLE) THEN 0 END END AS selection_correct
    FROM wide_clicks"""

_WIDE_SQL = """
    SELECT * EXCLUDE (response), string_split(instruction3, ' ')[-1] AS item,
        string_split(regexp_replace(response, '[\\[\\]'' ]|AOI', '', 'g'), ',')[1] AS click1,
        string_split(regexp_replace(response, '[\\[\\]'' ]|AOI', '', 'g'), ',')[2] AS click2,
        string_split(regexp_replace(response, '[\\[\\]'' ]|AOI', '', 'g'), ',')[3] AS click3,
        string_split(regexp_replace(response, '[\\[\\]'' ]|AOI', '', 'g'), ',')[4] AS click4
    FROM choice_trials"""

_EITHER = "CASE WHEN location = {0}1 THEN 1 WHEN location <> {0}1 THEN CASE WHEN location = {0}2 THEN 1 WHEN location <> {0}2 THEN 0 END END"
_LONG_SQL = f"""
    SELECT *, CASE WHEN target_look = 1 THEN 0 WHEN target_look <> 1 THEN
        CASE WHEN competitor_look = 1 THEN 0 WHEN competitor_look <> 1 THEN 1 END END AS distractor_look
    FROM (
        SELECT *, {_EITHER.format('target')} AS target_look, {_EITHER.format('competitor')} AS competitor_look
        FROM (
            SELECT * EXCLUDE (click1, click2, click3, click4),
                unnest(['click1', 'click2', 'click3', 'click4']) AS click_number,
                unnest([click1, click2, click3, click4]) AS location
            FROM experimental_clicks
        ) AS m
    ) AS f"""

_TRACKED_SQL = """
    SELECT *, CASE WHEN targetlook = 1 THEN 1 WHEN targetlook <> 1 THEN
            CASE WHEN distractorlook = 1 THEN 1 WHEN distractorlook <> 1 THEN 0 END END AS targetdistractorlook,
        CASE WHEN competitorlook = 1 THEN 1 WHEN competitorlook <> 1 THEN
            CASE WHEN distractorlook = 1 THEN 1 WHEN distractorlook <> 1 THEN 0 END END AS competitordistractorlook
    FROM (
        SELECT *, string_split(instruction, ' ')[-1] AS item,
            CASE whichword WHEN 'determiner' THEN 'determiner+name' WHEN 'name' THEN 'determiner+name'
                WHEN 'end' THEN 'noun' ELSE whichword END AS window,
            CASE WHEN targetlook = 1 THEN 0 WHEN targetlook <> 1 THEN
                CASE WHEN competitorlook = 1 THEN 0 WHEN competitorlook <> 1 THEN
                    CASE WHEN residuelook = 1 THEN 0 WHEN residuelook <> 1 THEN 1 END END END AS distractorlook
        FROM tracker WHERE TrackLoss = 'FALSE'
    ) AS t"""

_BELIEF_SQL = """
    SELECT CASE WHEN determiner IN ('two', 'three') THEN 'number' ELSE determiner END AS determiner,
        size, "window", item, unnest(['target', 'competitor', 'distractor']) AS Region,
        unnest([st, sc, sd]) AS prop_selections, unnest([lt, lc, ld]) AS prop_looks
    FROM (
        SELECT determiner, size, CASE click_number WHEN 'click1' THEN 'baseline' WHEN 'click2' THEN 'gender'
                WHEN 'click3' THEN 'determiner+name' ELSE 'noun' END AS "window", item,
            avg(target_look) AS st, avg(competitor_look) AS sc, avg(distractor_look) AS sd
        FROM long_clicks GROUP BY ALL
    ) AS s JOIN (
        SELECT determiner, size, "window", item, avg(targetlook) AS lt, avg(competitorlook) AS lc,
            avg(distractorlook) AS ld
        FROM tracked GROUP BY ALL
    ) AS l USING (determiner, size, "window", item)"""


def _duck(source: str, text: str) -> str:
    filled = text.replace("{" + source + "}", source)
    for name, value in _DUCK.items():
        filled = filled.replace("{" + name + "}", value)
    return filled


# In order of dependence.
VIEWS = {
    "gaze_samples": (_duck("lineitem", _GAZE_SAMPLES), ()),
    "onsets": (_duck("nation", _ONSETS), ()),
    "choice_trials": (_duck("orders", _CHOICE_TRIALS), ()),
    "tracker": (_duck("events", _TRACKER), ()),
    "subjects": (_duck("customer", _SUBJECTS), ()),
    "stimuli": (_duck("part", _STIMULI), ()),
    "practice": (_duck("part", _PRACTICE), ()),
    "gaze_lists": (_GAZE_LISTS_SQL, ()),
    "list_samples": (_LIST_SAMPLES_SQL, ("gaze_lists",)),
    "looks": (_LOOKS_SQL.format(source="gaze_samples"), ("gaze_samples",)),
    "list_looks": (_LOOKS_SQL.format(source="list_samples"), ("list_samples",)),
    "aligned": (_ALIGNED_SQL.format(looks="looks"), ("looks", "onsets")),
    "list_aligned": (_ALIGNED_SQL.format(looks="list_looks"), ("list_looks", "onsets")),
    "binned": (_BINNED_SQL.format("aligned"), ("aligned",)),
    "list_binned": (_BINNED_SQL.format("list_aligned"), ("list_aligned",)),
    "wide_clicks": (_WIDE_SQL, ("choice_trials",)),
    "scored_clicks": (_SELECTION_SQL, ("wide_clicks",)),
    "experimental_clicks": ("SELECT * FROM scored_clicks WHERE ExpFiller = 'Exp'", ("scored_clicks",)),
    "long_clicks": (_LONG_SQL, ("experimental_clicks",)),
    "tracked": (_TRACKED_SQL, ("tracker",)),
    "belief": (_BELIEF_SQL, ("long_clicks", "tracked")),
}


def sql(views: str, body: str) -> str:
    """``body`` with the named views, and those they rest on, in front of it."""
    needed: set[str] = set()

    def need(name: str) -> None:
        for other in VIEWS[name][1]:
            need(other)
        needed.add(name)

    for name in views.split():
        need(name)
    parts = [f"{name} AS ({VIEWS[name][0].strip()})" for name in VIEWS if name in needed]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()
