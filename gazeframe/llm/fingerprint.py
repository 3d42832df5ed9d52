"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch holds every shingle hash below a fixed fraction of the hash range, so it grows with the document, the
union of two sketches is the sketch of both documents together, and the share of one sketch found in another
estimates containment however unequal the two are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.text import hashes, let, windows, words

SHINGLE = 5
FRACTION = 1 / 8
_LOWEST = -(1 << 63)


def limit_of(fraction: float) -> int:
    """The hash below which the given fraction of all signed 64-bit hashes lies."""
    return min(_LOWEST + int(fraction * (1 << 64)), (1 << 63) - 1)


def sketch(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted hashes of the lower-cased word shingles of a text that lie below the fraction.

    A text of fewer words is one shingle. NULL and blank texts have an empty sketch. A text with words whose
    hashes all lie above keeps its least one, so that short texts stay apart; :func:`merged` drops it again.
    """

    def kept(runs: Column) -> Column:
        below = F.array_sort(F.array_distinct(F.filter(runs, lambda h: h < limit_of(fraction))))
        return let(
            below,
            lambda found: F.when((F.size(found) == 0) & (F.size(runs) > 0), F.array(F.array_min(runs))).otherwise(found),
        )

    def runs_of(hashed: Column) -> Column:
        short = F.when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.slice(hashed, F.lit(1), F.lit(0)))
        return F.when(F.size(hashed) < shingle, short).otherwise(windows(hashed, shingle))

    return let(let(hashes(words(F.lower(text))), runs_of), kept)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of two documents together; of single hashes above the fraction only the least stays."""
    both = F.array_sort(F.array_union(a, b))
    return let(both, lambda x: F.filter(x, lambda h, i: (h < limit_of(fraction)) | (i == 0)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    return F.when(
        F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    ).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; an empty ``a`` lies in everything."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``docs`` with ``next_<column>`` of the following row by doc_id, the last row followed by the first.

    Rows of one doc_id follow each other by text; NULL ids come first. Ids are cut into ranges at values that
    occur, so each range begins with a known row, which is also dealt to the end of the range before. One
    shuffle by range, no sort of everything, no join.
    """
    spark = docs.sparkSession
    parts = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    shares = F.expr(f"array({', '.join(f'{i / parts}D' for i in range(1, parts))}, 1.0D)")
    cuts = docs.select(key.alias("key")).agg(
        F.array_sort(
            F.array_distinct(F.concat(F.array(F.min("key")), F.percentile_approx("key", shares, 8 * parts)))
        ).alias("cuts")
    )
    steps = F.sequence(F.lit(1), F.lit(max(parts, 2).bit_length() + 1))

    def search(s: Column, _: Column) -> Column:
        """Halve the stretch of cuts in which the last one not above the id lies."""
        half = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(F.col("__cuts"), half) > F.col("__key")
        return F.struct(
            F.when(above, s["lo"]).otherwise(half).alias("lo"), F.when(above, half).otherwise(s["hi"]).alias("hi")
        )

    start = F.struct(F.lit(0).alias("lo"), F.size("__cuts").alias("hi"))
    found = F.aggregate(steps, start, search)["lo"]
    placed = (
        docs.withColumns({"__cuts": cuts.scalar(), "__key": key})
        .withColumn("__at", found)
        .withColumns({"__first": F.col("__key") == F.get("__cuts", F.col("__at")), "__all": F.size("__cuts")})
        .drop("__cuts")
    )
    own = F.struct(F.col("__at").alias("at"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("__at") - 1, F.col("__all")).alias("at"), F.lit(True).alias("tail"))
    dealt = placed.select(
        "*", F.explode(F.when(F.col("__first"), F.array(own, before)).otherwise(F.array(own))).alias("__to")
    ).select("*", F.col("__to.at").alias("__in"), F.col("__to.tail").alias("__tail"))
    order = Window.partitionBy("__in").orderBy("__tail", "__key", "text")
    return (
        dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
        .where(~F.col("__tail"))
        .drop("__to", "__in", "__tail", "__first", "__all", "__at", "__key")
    )


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edit, and their likenesses.

    The edit replaces the last floor(n_chars / 2) code points by the first as many, or all, of the next
    document. NULL texts count as empty ones. Returns doc_id, n_chars, edited_text, sketch, edited_sketch,
    next_sketch, near_edited and near_next; other columns of ``docs`` are left out, repeated rows stay.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = plain.withColumns({"sketch": sketch(F.col("text")), "n_chars": F.length("text").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    body = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)
    )
    made = with_next(known, ["text", "sketch"]).select(
        "doc_id", "n_chars", "sketch", "next_sketch", body.alias("edited_text")
    )
    return made.withColumn("edited_sketch", sketch(F.col("edited_text"))).withColumns(
        {
            "near_edited": likeness(F.col("sketch"), F.col("edited_sketch")),
            "near_next": likeness(F.col("sketch"), F.col("next_sketch")),
        }
    )
