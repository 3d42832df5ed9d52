"""The gaze study: trial rows to aligned, binned looks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.functions.aoi import (
    MAIN_RANGE,
    Layout,
    first_box,
    in_range,
    quadrant,
    role,
    role_flags,
)
from gazeframe.functions.nulls import one_of_two
from gazeframe.functions.text import parse_list
from gazeframe.operators.alignment import (
    TRIAL,
    align,
    bin_time,
    with_first_sample,
)
from gazeframe.operators.exclusions import apply_exclusions
from gazeframe.operators.explode import checked_zip
from gazeframe.operators.relational import left_join_renamed, settle

# List columns of a trial and their item types.
SERIES = {"webgazer_time": "double", "unixtlist": "bigint", "x": "double", "y": "double"}


def locate(trials: DataFrame) -> DataFrame:
    """Quadrant names of target and competitor from their AOI numbers."""
    number = {c: F.col(c).try_cast("int") for c in ("target1", "target2", "competitor1", "competitor2")}
    return trials.withColumns(
        {
            "target_location": quadrant(number["target1"], number["target2"]),
            "competitor_location": quadrant(number["competitor1"], number["competitor2"]),
        }
    )


def score_selection(trials: DataFrame, response: str = "response") -> DataFrame:
    """``selection_correct``; compared as text, NULL where it cannot be told."""
    answers = [F.col(c).cast("string") for c in (response, "target1", "target2")]
    return trials.withColumn("selection_correct", one_of_two(*answers))


def add_onsets(trials: DataFrame, onsets: DataFrame) -> DataFrame:
    return left_join_renamed(trials, onsets, "audio", "Prime")


def prepare_trials(trials: DataFrame, onsets: DataFrame) -> DataFrame:
    """Trials with quadrants, onsets, scored selection, camera view and language."""
    scored = score_selection(locate(trials)).withColumns(
        {
            "camview": F.col("subject_information_camblock"),
            "language": F.lower("subject_information_language"),
        }
    )
    return add_onsets(scored, onsets)


def analysed_trials(trials: DataFrame, **options) -> DataFrame:
    """Correct experimental trials of accurate workers; practice does not count as accuracy."""
    kind = F.col("trial_type")
    return apply_exclusions(trials, scored=kind != "Prac", wanted=kind == "Exp", **options)


def classify(
    samples: DataFrame,
    layout: Layout = Layout(),
    swap: bool = False,
    bounds: tuple[float, ...] | None = MAIN_RANGE,
    window: tuple[str, str] = ("system_windowW", "system_windowH"),
) -> DataFrame:
    """Look, role and role flags of each sample; samples out of ``bounds`` go."""
    x, y = F.col("x"), F.col("y")
    kept = samples if bounds is None else samples.where(in_range(x, y, *bounds))
    look = layout.look(x, y, F.col(window[0]), F.col(window[1]))
    return with_roles(settle(kept, {"look": look}), swap)


def with_roles(looks: DataFrame, swap: bool = False) -> DataFrame:
    roi = role(F.col("look"), F.col("target_location"), F.col("competitor_location"))
    return looks.withColumn("ROI", roi).withColumns(role_flags(F.col("ROI"), swap))


def classified_trials(
    trials: DataFrame,
    layout: Layout = Layout(),
    bounds: tuple[float, ...] = MAIN_RANGE,
    window: tuple[str, str] = ("system_windowW", "system_windowH"),
    sep: str | None = ",",
    origin: str = "classified",
) -> DataFrame:
    """Classify samples while they are lists and find each trial's first sample.

    A trial's samples sit in its row, so its origin is the smallest time in its
    own lists. This spares the shuffle of all samples by trial. Lists of unequal
    length raise an error. Adds ``samples``, an array of the samples that look at
    a region, and ``first_sample`` and ``first_unix``.
    """
    if sep is not None:
        trials = trials.withColumns(
            {name: parse_list(F.col(name), kind, sep) for name, kind in SERIES.items()}
        )
    sides = ("x_min", "x_max", "y_min", "y_max")
    boxes = layout.boxes(F.col(window[0]), F.col(window[1]))
    per_trial = F.struct(
        *[
            F.struct(*[bound.alias(side) for side, bound in zip(sides, box)]).alias(name)
            for name, box in boxes.items()
        ]
    )
    staged = settle(trials, {"_boxes": per_trial, "_series": checked_zip(list(SERIES))})
    known = {name: tuple(F.col(f"_boxes.{name}.{side}") for side in sides) for name in boxes}

    def place(sample):
        look = first_box(sample["x"], sample["y"], known)
        return F.struct(*[sample[name].alias(name) for name in SERIES], look.alias("look"))

    near = F.filter("_series", lambda sample: in_range(sample["x"], sample["y"], *bounds))
    placed = staged.withColumn("_placed", F.transform(near, place))
    seen = F.filter("_placed", lambda sample: sample["look"] != "other")
    settled = settle(placed.drop("_boxes", "_series", *SERIES), {"_placed": F.col("_placed"), "samples": seen})
    source = "samples" if origin == "classified" else "_placed"
    return settled.withColumns(
        {
            "first_sample": F.array_min(F.col(f"{source}.webgazer_time")),
            "first_unix": F.array_min(F.col(f"{source}.unixtlist")),
        }
    ).drop("_placed")


def looks_from_lists(trials: DataFrame, swap: bool = False, **options) -> DataFrame:
    """Classified samples of list-shaped trials, one row per sample, ``other`` dropped."""
    listed = classified_trials(trials, **options)
    others = [name for name in listed.columns if name != "samples"]
    return with_roles(listed.select(*others, F.inline("samples")), swap)


def aligned_looks(looks: DataFrame, origin: str = "classified", shift: int = 0) -> DataFrame:
    """Samples that look at a region, aligned to the word onsets.

    ``origin="classified"`` takes a trial's first sample that looks at a region,
    ``"raw"`` its first sample of all. Looks that come with ``first_sample``, as
    those from lists do, keep it.
    """
    seen = looks.where(F.col("look") != "other")
    if "first_sample" not in looks.columns:
        source = seen if origin == "classified" else looks
        seen = with_first_sample(seen, TRIAL, origin=source)
    return align(seen, shift=shift)


def binned_looks(looks: DataFrame, origin: str = "classified", shift: int = 0) -> DataFrame:
    return bin_time(aligned_looks(looks, origin, shift))


# The samples of each model, the onset its time counts from, and where the noun's samples end.
MODEL_WINDOWS = {
    "determiner+name": (("determiner", "name"), "determiner"),
    "baseline": (("baseline",), "name"),
    "gender": (("gender",), "name"),
    "determiner": (("determiner",), "determiner"),
    "name": (("name",), "name"),
    "noun": (("noun",), "name"),
}
NOUN_CUT_MS = 600


def model_looks(looks: DataFrame, noun_cut: float = NOUN_CUT_MS) -> DataFrame:
    """Samples with ``model`` and ``model_time``, once for every model that holds their window.

    ``model_time`` is in units of 100 ms since the model's own onset. Samples of the noun window from
    ``noun_cut`` ms after the noun's onset on are in no model.
    """
    early = (F.col("window") != "noun") | (F.col("time_rel_noun_onset") < noun_cut)
    choices = [
        F.when(
            F.col("window").isin(*names) & early,
            F.struct(F.lit(model).alias("model"), (F.col(f"time_rel_{onset}_onset") / 100).alias("model_time")),
        )
        for model, (names, onset) in MODEL_WINDOWS.items()
    ]
    return looks.select("*", F.inline(F.filter(F.array(*choices), lambda c: c.isNotNull())))
