"""Declared schemas of the experiment logs. Dots in column names become ``_``."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def _struct(**kinds: str) -> T.StructType:
    return T.StructType(
        [T.StructField(name, _KINDS[kind]) for kind, names in kinds.items() for name in names.split()]
    )


# Column names of the logs and stimulus tables.
LOCATIONS = " ".join(f"location{i}" for i in range(1, 11))

GAZE_TRIAL = T.StructType(
    [
        *_struct(
            bigint="workerid slide_number",
            string="displayID trial_type setting figure display_type audio list "
            + LOCATIONS
            + " condition size determiner target1 target2 competitor1 competitor2"
            " target_num_object target_figure target_object correctAns1 correctAns2 response",
        ),
        *_struct(bigint="response_time trial_start audio_play_unix unix_rt"),
        *_struct(string="webgazer_time unixtlist x y"),
        *_struct(int="system_windowW system_windowH"),
        *_struct(double="subject_information_accuracy subject_information_time_in_minutes"),
        *_struct(int="subject_information_age"),
        *_struct(
            string="subject_information_camblock subject_information_comments"
            " subject_information_eyesight subject_information_eyesight_task"
            " subject_information_gender subject_information_headphones"
            " subject_information_language subject_information_previous_accuracy_attempts"
            " system_Browser system_OS"
        ),
    ]
)

CHOICE_TRIAL = T.StructType(
    [
        *_struct(bigint="workerid"),
        *_struct(
            string="displayID setting figure display_type "
            + LOCATIONS
            + " Prime target1 target2 competitor1 competitor2 condition determiner size"
            " ExpFiller correctAns1 correctAns2 list target_object3 target_figure3"
            " instruction3 response response_times"
        ),
        *_struct(double="Answer_time_in_minutes"),
    ]
)

ONSETS = T.StructType(
    [
        *_struct(string="Prime Name Noun"),
        *_struct(
            double="click_onset_ms gender_onset_ms determiner_onset_ms name_onset_ms noun_onset_ms"
            " click_onset_ms_200shift gender_onset_ms_200shift determiner_onset_ms_200shift"
            " name_onset_ms_200shift noun_onset_ms_200shift"
        ),
    ]
)

TRACKER = T.StructType(
    [
        *_struct(string="Prime Subject instruction condition determiner size whichword TrackLoss"),
        *_struct(int="time targetlook competitorlook residuelook"),
        *_struct(double="gender_onset determiner_onset name_onset noun_onset"),
    ]
)

SUBJECT = T.StructType(
    [
        *_struct(string="fairprice problems gender"),
        *_struct(int="age"),
        *_struct(bigint="workerid"),
        *_struct(string="language comments asses"),
        *_struct(int="education enjoyment"),
        *_struct(string="speaker_cond"),
    ]
)

STIMULUS_COLUMNS = tuple(
    (
        "displayID setting figure display_type "
        + LOCATIONS
        + " Prime target1 target2 competitor1 competitor2 condition determiner size ExpFiller"
        " correctAns1 correctAns2 list target_object3 target_figure3 object3 instruction3"
    ).split()
)
STIMULUS_UNDERSCORED = tuple(f"location{i}" for i in range(1, 7)) + ("target_object3",)

# The source repeats the name object1; the second one is renamed here.
PRACTICE_COLUMNS = tuple(
    (
        "displayID ExpFiller setting figure Intro_object Res_object object1 object2 object3"
        " object4 display_type "
        + LOCATIONS
        + " condition1 size1 target1 competitor1 target_object1 target_figure1 determiner1"
        " object1_noun instruction1 prime correctAns1 correctAns2"
    ).split()
)
PRACTICE_UNDERSCORED = (
    ("Res_object", "object1", "object2", "object3", "object4")
    + tuple(f"location{i}" for i in range(1, 7))
    + ("target_object1",)
)
