"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source with token share q gets the weight q^t / sum(q^t). The exponent t is bisected to meet a target entropy,
and lowered no further than a limit on repetition allows. Each source's tokens are then cut into blocks in a keyed
order, and blocks are dealt, epoch after epoch, until the source's budget is met; only the last block is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.text import words

BISECTIONS = 60


def source_tokens(docs: DataFrame) -> DataFrame:
    """Tokens and documents by source; needs ``source`` and ``n_tokens``."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def weights(
    sources: DataFrame, entropy: float = 0.95, most_epochs: float = 4.0, budget: float = 1.0, keep_all: bool = False
) -> DataFrame:
    """Columns source, tokens, ``exponent``, ``weight``, ``budget`` (tokens) and ``epochs`` = budget / tokens.

    ``entropy`` is the target as a share of that of equal weights. The exponent is the largest in 0 to 1 whose
    weights reach it; if a source then repeats more than ``most_epochs`` times, it is raised just far enough to
    keep the limit (1 always does when ``budget`` is at most ``most_epochs``). ``budget`` is the size of the mix
    as a multiple of all tokens; ``keep_all`` makes it as large as the source that the mix favours least needs
    for one whole epoch. Sources without tokens get weight 0 and no epoch; a NULL source is a source. Works on
    one row with an array of all sources, which are few against documents.
    """
    kept = sources.where("tokens > 0")
    total = kept.agg(
        F.sum("tokens").alias("total"),
        F.transform(F.array_sort(F.collect_list("tokens")), lambda t: t.cast("double")).alias("tokens"),
    )
    shares = total.select("total", "tokens", F.transform("tokens", lambda t: t / F.col("total")).alias("q"))

    def powered(t: Column) -> Column:
        return F.transform("q", lambda q: F.pow(q, t))

    def summed(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def evenness(t: Column) -> Column:
        z = summed(powered(t))
        # -sum p ln p with p = q^t / z
        return F.log(z) - t * summed(F.transform("q", lambda q: F.pow(q, t) * F.log(q))) / z

    def size(t: Column) -> Column:
        """Tokens of the mix."""
        z = summed(powered(t))
        if not keep_all:
            return F.col("total") * F.lit(budget)
        return z * F.array_max(F.transform("q", lambda q: F.pow(q, 1 - t))) * F.col("total")

    def repeats(t: Column) -> Column:
        """The most epochs of a source: budget * p / tokens."""
        return size(t) / F.col("total") * F.array_max(F.transform("q", lambda q: F.pow(q, t - 1))) / summed(powered(t))

    def bisected(fits, low: Column, high: Column) -> Column:
        """The end of ``low`` to ``high`` where ``fits`` turns from true (low) to false (high)."""

        def halve(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2
            good = fits(middle)
            return F.struct(
                F.when(good, middle).otherwise(s["low"]).alias("low"), F.when(good, s["high"]).otherwise(middle).alias("high")
            )

        start = F.struct(low.alias("low"), high.alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve)

    zero, one = F.lit(0.0), F.lit(1.0)
    target = F.log(F.size("q").cast("double")) * entropy - 1e-12
    even = F.when(evenness(one) >= target, one).otherwise(bisected(lambda t: evenness(t) >= target, zero, one)["low"])
    fitted = shares.withColumn("even", even)
    limited = F.when(repeats(F.col("even")) <= most_epochs, F.col("even")).otherwise(
        bisected(lambda t: repeats(t) > most_epochs, F.col("even"), one)["high"]
    )
    found = fitted.withColumn("exponent", limited).select(
        "exponent", summed(powered(F.col("exponent"))).alias("z"), size(F.col("exponent")).alias("size"), "total"
    )
    mix = sources.crossJoin(F.broadcast(found))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).otherwise(0.0)
    return (
        mix.withColumn("weight", weight)
        .withColumn("budget", F.col("weight") * F.col("size"))
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(0.0))
        .select("source", "tokens", "docs", "exponent", "weight", "budget", "epochs")
    )


def mixture(
    docs: DataFrame,
    entropy: float = 0.95,
    most_epochs: float = 4.0,
    budget: float = 1.0,
    keep_all: bool = False,
    block_tokens: int = 200_000,
    slices: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """The documents of the mix, each as often as it is dealt.

    Columns of ``docs`` and ``n_tokens`` (words and one end), ``epoch`` from 0, ``block``, ``weight``, and
    ``mix_key`` from 0 to 1: sorted by it, every stretch of the mix has about the target weights. A source, also
    one that holds a third of all rows, is cut by a hash of the id into ``slices``, which are gathered to blocks
    of about ``block_tokens``. In every epoch blocks, the slices in a block and the documents in a slice come in
    another keyed order. The last, unfinished epoch takes whole slices while they fit the rest of the budget, so
    the dealt tokens fall short of it by less than one slice. Only totals of slices are put in order.

    NULL and empty texts are one token; a NULL source is a source; repeated rows are dealt each; an empty table
    gives no row. Columns of ``docs`` named like a result are replaced.
    """
    made = ("n_tokens", "epoch", "block", "weight", "mix_key")
    plain = docs.drop(*[c for c in docs.columns if c in made])
    slices = slices or 64 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = plain.withColumns(
        {
            "n_tokens": (F.size(words(F.col("text"))) + 1).cast("long"),
            "__source": F.struct("source"),
            "__slice": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(slices)),
        }
    )
    totals = sliced.groupBy("source", "__source", "__slice").agg(F.sum("n_tokens").alias("__in"), F.count("*").alias("docs"))
    sums = totals.groupBy("source").agg(F.sum("__in").alias("tokens"), F.sum("docs").alias("docs"))
    mix = weights(sums, entropy, most_epochs, budget, keep_all).select(
        F.struct("source").alias("__source"), "weight", "budget", "epochs", "tokens"
    )
    whole = F.floor(F.col("epochs") + 1e-9).cast("int")
    parts = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1))
    order = Window.partitionBy("__source", "epoch").orderBy(
        F.xxhash64("block", "epoch", F.lit(seed)), "block", F.xxhash64("__slice", "epoch", F.lit(seed)), "__slice"
    )
    after = F.sum("__in").over(order)
    rest = F.when(F.col("epoch") < F.col("__whole"), F.lit(float("inf"))).otherwise(
        F.col("budget") - F.col("__whole") * F.col("tokens")
    )
    dealt = (
        totals.drop("source", "docs")
        .join(mix, "__source")
        .withColumn("block", F.pmod("__slice", parts).cast("long"))
        .withColumn("__whole", whole)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__whole"))))
        .withColumn("__after", after)
        .where(F.col("__after") <= rest)
        .groupBy("__source", "__slice")
        .agg(
            F.collect_list(
                F.struct(
                    "epoch",
                    "block",
                    "weight",
                    ((F.col("epoch") * F.col("tokens") + F.col("__after") - F.col("__in")) / F.col("budget")).alias("at"),
                    (F.col("__in") / F.col("budget")).alias("width"),
                )
            ).alias("__deals")
        )
    )
    copies = sliced.join(dealt, ["__source", "__slice"]).withColumn("__deal", F.explode("__deals"))
    inside = F.pmod(F.xxhash64("doc_id", F.col("__deal.epoch"), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return copies.select(
        *[f"`{c}`" for c in plain.columns],
        "n_tokens",
        "__deal.epoch",
        "__deal.block",
        "__deal.weight",
        (F.col("__deal.at") + inside * F.col("__deal.width")).alias("mix_key"),
    )
