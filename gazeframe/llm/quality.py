"""Quality rules: a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus.

Every text is counted into two multinomials over hashed n-grams: one of all documents and one of trusted
documents. A document's score is the mean log ratio of its n-grams, so length does not matter; it is kept when
the score reaches a threshold and the base rules pass. The same document always gets the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.text import hashes, let, paired, windows, words

BUCKETS = 1 << 16
#: Counts that each bucket has on either side before any text is read.
PRIOR = 20.0
#: Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
FEWEST_WORDS = 20
WINDOW = 8
MOST_REPEATED_PERCENT = 30


def grams(words_: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every word and of every two words in a row."""
    both = let(hashes(words_), lambda h: F.concat(h, paired(h, 1, lambda a, b: F.xxhash64(a, b))))
    return F.transform(both, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def repeated_words(hashed: Column, window: int = WINDOW) -> Column:
    """Words inside a window of words that the text has twice or more, the first one included."""

    def covered(runs: Column) -> Column:
        tagged = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(rows: Column, x: Column, k: Column) -> Column:
            return (x.h == F.get(rows, k - 1).h) | (x.h == F.get(rows, k + 1).h)

        twice = let(
            tagged,
            lambda rows: F.array_sort(
                F.transform(F.filter(rows, lambda x, k: F.coalesce(same(rows, x, k), F.lit(False))), lambda x: x.i)
            ),
        )
        return let(
            twice,
            lambda at: F.aggregate(
                paired(at, 1, lambda a, b: F.least(b - a, F.lit(window))), F.lit(0), lambda s, x: s + x
            )
            + F.when(F.size(at) > 0, window).otherwise(0),
        )

    return let(
        windows(hashed, window),
        lambda runs: F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(covered(runs)),
    ).cast("long")


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``words`` and the base counts; a NULL text counts as one without words.

    ``n_dup_lines`` are lines with a word that equal an earlier line. ``base_failed`` says that the text has
    fewer than 20 words or that over 30 % of its words lie in 8-word runs found at least twice.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    counted = docs.withColumns({"words": words(body), "__lines": lines}).withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_words(hashes(F.col("words"))),
        }
    )
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < FEWEST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
    ).drop("__lines")


def trusted_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids of documents all of whose labels say good and not toxic, the least by hash.

    This is the bounded sample the target multinomial is fitted on; rows without id or quality are left out.
    """
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("quality = 1 AND toxic = 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id", F.lit(1).alias("trusted"))
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row with the array ``w`` of log p(target) - log p(raw) per bucket, smoothed by ``prior`` counts.

    A bucket's target count is held against the count that the raw share gives as many target n-grams, and both
    get ``prior`` counts more. So a bucket without evidence has ratio 0, however few trusted texts there are:
    rare words, and languages with few labels, are not held against a document. Rows are summed per bucket before the shuffle; what is left is ``buckets`` rows at any input size.
    """
    flagged = docs.select("doc_id", words(F.col("text")).alias("words")).join(
        F.broadcast(trusted), "doc_id", "left"
    )
    counts = (
        flagged.select(F.explode(grams(F.col("words"), buckets)).alias("bucket"), "trusted")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    )
    empty = docs.sparkSession.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target")
    )
    dense = counts.unionByName(empty).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    rows = dense.groupBy().agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"),
        F.sum("raw").alias("all_raw"),
        F.sum("target").alias("all_target"),
    )

    # As many target n-grams as there are, dealt by raw shares.
    factor = F.col("all_target") / F.greatest(F.col("all_raw"), F.lit(1))
    ratio = F.transform("rows", lambda r: F.log((r.target + prior) / (r.raw * factor + prior)))
    neutral = F.transform("rows", lambda r: F.lit(0.0))
    return rows.select(F.when(F.col("all_target") > 0, ratio).otherwise(neutral).alias("w"))


def score(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (with ``words``) and ``llr``: the mean log ratio of a document's n-grams, 0 without any."""
    gathered = docs.withColumn("__grams", grams(F.col("words"), buckets)).withColumn("__w", weights.scalar())
    total = F.aggregate("__grams", F.lit(0.0), lambda s, g: s + F.col("__w")[g])
    return gathered.withColumn("llr", total / F.greatest(F.size("__grams"), F.lit(1))).drop("__grams", "__w")


def assess(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = -0.05,
    trusted_rows: int = 20_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``llr`` and ``kept``.

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic. A document is kept when the base rules
    pass and its mean log ratio is at least ``threshold``: at zero, trusted text is as likely to have such n-grams
    as the corpus is; the default leaves a margin below. NULL and empty texts fail the base rules; a NULL doc_id is scored like
    any other; repeated rows are judged and counted each. Without trusted documents all ratios are zero and only
    the base rules decide. Columns of ``docs`` named like a result are replaced.
    """
    made = ["words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    docs = docs.drop(*[c for c in docs.columns if c in made])
    trusted = trusted_sample(labels, trusted_rows)
    weights = log_ratios(docs.select("doc_id", "text"), trusted, buckets)
    scored = score(base_rules(docs), weights, buckets)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("words")
