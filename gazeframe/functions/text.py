"""String and list-text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_list_text(text: Column) -> Column:
    """``['AOI1', 'AOI7']`` becomes ``1,7``."""
    return F.regexp_replace(text, r"[\[\]' ]|AOI", "")


def strip_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"[\[\]]", "")


def split_fixed(text: Column, names: Sequence[str], sep: str = ",") -> list[Column]:
    """One column per name; missing parts are NULL and extra parts are dropped."""
    parts = F.split(text, sep)
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)]


def parse_list(text: Column, type_name: str, sep: str = ",") -> Column:
    """Bracketed list text to a typed array; an item that is no number becomes NULL.

    Brackets anywhere in the text are ignored, so lists that were put together item by item lose nothing. Whole
    numbers are read as decimals first: a fraction in an integer list is cut off, not lost. Casts ignore blanks
    around an item, so one character is enough for ``sep``.
    """
    body = F.btrim(F.translate(text, "[]", ""))
    whole = type_name in ("tinyint", "smallint", "int", "bigint")

    def item(part: Column) -> Column:
        return part.try_cast("decimal(38,9)").try_cast(type_name) if whole else part.try_cast(type_name)

    return F.when(body == "", F.array().cast(f"array<{type_name}>")).otherwise(F.transform(F.split(body, sep), item))


def to_number(text: Column, type_name: str = "double") -> Column:
    return text.try_cast(type_name)


def last_word(text: Column) -> Column:
    return F.element_at(F.split(text, " "), -1)


def item_key(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def name_part(name: Column, k: int, sep: str = "_") -> Column:
    """Part ``k`` (from 1) of a name such as ``target_prop``."""
    return F.split_part(name, F.lit(sep), F.lit(k))


# Words shown at each step of an incremental trial.
STEP_WORDS = (3, 6, 9, 10)


def incremental_prefixes(instruction: Column, steps: Sequence[int] = STEP_WORDS) -> Column:
    """Array of ``(step, shown)``: the first words of the instruction per step.

    Every step but the last ends in an ellipsis, the last in a full stop.
    """
    words = F.split(instruction, " ")
    shown = []
    for step, n_words in enumerate(steps, start=1):
        suffix = "." if step == len(steps) else " ..."
        text = F.concat(F.array_join(F.slice(words, 1, n_words), " "), F.lit(suffix))
        shown.append(F.struct(F.lit(step).alias("step"), text.alias("shown")))
    return F.array(*shown)
