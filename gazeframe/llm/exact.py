"""Exact duplicates: rows grouped by a 128-bit hash of their text, with the bytes of each group compared."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.components import written

#: A group with more than one in this many of all rows is hot; so there are fewer hot groups than this.
HOT_SHARE = 1000


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def collided(texts: DataFrame) -> DataFrame:
    """(hash, text, variant) of every text that shares its hash with another text; ``variant`` counts from 1.

    Copies are merged inside each task before the shuffle, so a text crosses it once a task, however many copies
    it has. The aggregate's own key comparison is the comparison of bytes.
    """
    each = texts.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("copies"))
    several = each.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash")
    # Written first: joined to a table known to be empty or small, the texts are not shuffled again.
    different = texts.join(written(several, "shared-hashes"), "hash", "left_semi").groupBy("hash", "text")
    order = Window.partitionBy("hash").orderBy("text")
    counted = different.agg(F.count(F.lit(1)).alias("copies"))
    return counted.select("hash", "text", F.row_number().over(order).alias("variant"))


def exact_groups(
    docs: DataFrame,
    keep: str = "least",
    normalise: Callable[[Column], Column] = lambda text: text,
    carry: Sequence[str] = (),
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs`` with the group of equal texts that it belongs to.

    Returns doc_id, keep_id (doc_id of the row of the group that stays), group_size, kept, text_sha256 (hex, of
    the normalised text in UTF-8) and the columns named in ``carry``. ``keep`` is ``least`` or ``largest``.
    Rows are grouped by ``hashed`` of the normalised text; texts that share a hash but not their bytes are told
    apart by :func:`collided`, which finds none as long as the hash holds.

    A NULL text is an empty one; empty texts are copies of each other. A row without doc_id stays only where no
    row of its group has one, and keep_id is NULL then. Of rows with the same doc_id and text exactly one is kept.
    Any type of doc_id that can be ordered will do. Other columns are left out unless carried; carried ones must
    not be named like a result. An empty table gives no row.

    Rows without their text are written to the shared folder once, with a number per row that settles ties.
    Groups are then formed by an aggregate. Hot groups, fewer than ``HOT_SHARE``, are broadcast to their rows.
    """
    if keep not in ("least", "largest"):
        raise ValueError("keep is least or largest")
    body = normalise(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("doc_id", *carry, body.alias("__text")).withColumn("__hash", hashed(F.col("__text")))
    apart = written(collided(texts.select(F.col("__hash").alias("hash"), F.col("__text").alias("text"))), "collided")
    alone = texts.join(
        apart.toDF("__other_hash", "__other_text", "__variant"),
        (F.col("__hash") == F.col("__other_hash")) & (F.col("__text") == F.col("__other_text")),
        "left",
    ).select(
        "doc_id",
        *carry,
        "__hash",
        F.coalesce("__variant", F.lit(0)).alias("__variant"),
        F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = written(alone, "hashed")
    if keep == "largest":
        first = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("__row")))
        row = -first.getItem("col3")
    else:
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
        row = first.getItem("__row")
    key = ["__hash", "__variant"]
    groups = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("group_size"), first.getItem("doc_id").alias("keep_id"), row.alias("__first")
    )
    total = rows.agg(F.count(F.lit(1))).scalar()
    is_hot = F.col("group_size") * HOT_SHARE > total
    hot = F.broadcast(groups.where(is_hot))
    met = rows.join(hot, key).unionByName(
        rows.join(hot.select(*key), key, "left_anti").join(groups.where(~is_hot), key)
    )
    return met.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("__row") == F.col("__first")).alias("kept"),
        "text_sha256",
        *carry,
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    others = [c for c in docs.columns if c != "doc_id"]
    apart = [f"__own_{i}" for i in range(len(others))]
    whole = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(others, apart)])
    return (
        exact_groups(whole, carry=apart, **options)
        .where("kept")
        .select("doc_id", *[F.col(n).alias(c) for c, n in zip(others, apart)])
        .select(*[f"`{c}`" for c in docs.columns])
    )
