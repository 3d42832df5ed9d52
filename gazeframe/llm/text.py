"""Words and word hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that part words, as Java's ``\s`` has them.
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The runs of non-blank characters of a text; NULL and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"\s+")).otherwise(F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def paired(items: Column, gap: int, combine) -> Column:
    """``combine(x[i], x[i + gap])`` for every i that has both; ``items`` is a plain column."""
    n = F.greatest(F.size(items) - gap, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(1 + gap), n), combine)


def windows(hashed: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, by joining runs of growing length."""

    def joined(step: int):
        return lambda h: paired(h, step, lambda a, b: F.xxhash64(a, b))

    made, out = 1, hashed
    while made < length:
        step = min(made, length - made)
        out = let(out, joined(step))
        made += step
    return out
