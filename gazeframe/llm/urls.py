"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 12
LENGTHS = (3, 4, 5)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table to train on, blocked and allowed addresses.
BLOCKED = (
    "http://casino-royal.test/play",
    "http://www.casino-bonus.test/spin",
    "http://win-casino.test/en/win",
    "http://big-win.test/lottery",
    "http://cheap-meds.test/pills",
    "http://buy-pills.test/en/3",
    "http://cheap-pharmacy.test/pills/12",
    "http://www.discount-pills.test/order",
    "http://spam-mail.test/en/4",
    "http://spam-links.test/farm",
    "http://link-farm.test/spam",
    "http://content-farm.test/en/9",
    "http://adult-video.test/x",
    "http://adult-chat.test/en/5",
    "http://xxx-adult.test/video",
    "http://x-movies.test/adult",
    "http://free-bets.test/odds",
    "http://bets-online.test/en/7",
    "http://sports-bets.test/free",
    "http://free-money.test/claim",
    "http://ads-server.test/track",
    "http://track-click.test/ads",
    "http://ads-banner.test/en/8",
    "http://pixel-track.test/en/2",
    "http://pop-ads.test/click",
    "http://free-loan.test/apply",
)
ALLOWED = (
    "http://library.test/en/1",
    "http://blog.garden.test/fr/12",
    "http://m.weather.test/en/77",
    "http://www.museum.test/de/5.html",
    "http://history.test/es/31",
    "http://news.city.test/en/402",
    "http://www.school.test/fr/9",
    "http://recipes.test/en/88.html",
    "http://blog.travel.test/es/66",
    "http://m.science.test/de/120",
    "http://docs.python.test/en/3",
    "http://wiki.nature.test/fr/45",
    "http://www.theatre.test/en/700",
    "http://blog.mathematics.test/de/8",
    "http://music.test/en/314",
    "http://thinking.test/en/15",
    "http://www.other.test/en/27",
    "http://m.nothing.test/es/99",
    "http://blog.station.test/en/1001",
    "http://health.test/fr/2/",
    "http://northern.test/de/36/",
    "http://www.authors.test/en/58",
    "http://brother.test/es/7",
    "http://together.test/en/640",
    "http://another.test/fr/81",
    "http://reading.test/en/202/",
)

#: Rules of the query, (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` and ``path``; both are empty for a NULL url or one without ``://``."""
    address = F.col(f"`{url}`")
    rest = F.when(address.contains("://"), F.substring(address, F.instr(address, "://") + 3, F.length(address)))
    return df.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumns(
        {
            "host": F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), CAPITALS, SMALL),
            "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1),
        }
    ).drop("__rest")


def rule_of(rules: tuple, part: int) -> Column:
    """Of the longest rule that fits ``host`` and ``path``: its name (0) or verdict (1), else NULL."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, (host + path, verdict)[part]).otherwise(out)
    return out


def features(buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the character n-grams of ``host`` and ``path``; bucket 0 is always there."""

    def grams(name: str, n: int) -> Column:
        marked = F.concat(F.lit("^"), F.col(name), F.lit("$"))
        starts = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        hashed = F.transform(
            starts, lambda i: F.pmod(F.xxhash64(F.lit(name), F.substring(marked, i, F.lit(n))), F.lit(buckets - 1)).cast("int") + 1
        )
        return F.when(F.length(marked) >= n, hashed).otherwise(F.array().cast("array<int>"))

    parts = [grams(name, n) for name in ("host", "path") for n in LENGTHS]
    return F.array_distinct(F.concat(F.array(F.lit(0)), *parts))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``url`` and ``blocked`` (0 or 1)."""
    rows = [f"({url!r}, {int(blocked)})" for blocked, urls in ((True, BLOCKED), (False, ALLOWED)) for url in urls]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, blocked)")


def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = 300, rate: float = 2.0, decay: float = 0.001) -> DataFrame:
    """One row with the weights ``w`` by bucket, from a labelled table small enough for one row (some 1,000 urls).

    Gradient descent keeps the weights a sum of the examples, so a step only moves one coefficient per example:
    it needs the products of examples, made once, and no pass over the buckets. Rows without url or label are
    left out, repeated ones count as often as they occur; without any, all weights are zero.
    """
    known = with_parts(labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", "blocked"))
    example = known.select(features(buckets).alias("f"), F.col("blocked").cast("double").alias("y"), "url")
    table = example.groupBy().agg(F.array_sort(F.collect_list(F.struct("url", "y", "f"))).alias("rows"))
    product = F.transform(
        "rows",
        lambda a: F.transform(
            F.col("rows"), lambda b: F.size(F.array_intersect(a.f, b.f)) / F.sqrt((F.size(a.f) * F.size(b.f)).cast("double"))
        ),
    )
    products = table.select("rows", product.alias("k"), F.transform("rows", lambda r: r.y).alias("y"))

    def step(alpha: Column, _: Column) -> Column:
        def margin(row: Column) -> Column:
            return F.aggregate(F.zip_with(row, alpha, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)

        residual = F.zip_with(F.col("k"), F.col("y"), lambda row, y: y - 1 / (1 + F.exp(-margin(row))))
        return F.zip_with(alpha, residual, lambda a, e: a * (1 - rate * decay) + rate * e)

    start = F.transform("y", lambda y: F.lit(0.0))
    fitted = products.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("alpha"))
    parts = fitted.select(F.explode(F.arrays_zip("rows", "alpha")).alias("r")).select(
        F.explode("r.rows.f").alias("bucket"), (F.col("r.alpha") / F.sqrt(F.size("r.rows.f").cast("double"))).alias("w")
    )
    empty = labelled.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0.0).alias("w"))
    dense = parts.unionByName(empty).groupBy("bucket").agg(F.sum("w").alias("w"))
    return dense.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda x: x.w).alias("w")
    )


def judge(
    pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, buckets: int = BUCKETS, threshold: float = 0.4
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``probability`` of being blocked and ``verdict``.

    A rule decides where one fits, else the model: block from ``threshold`` on. Every row gets a verdict; NULL
    urls and such without ``://`` have empty parts and go to the model. Repeated rows stay. No shuffle: the
    weights are one array of ``buckets`` numbers. Columns of ``pages`` named like a result are replaced.
    """
    made = ["host", "path", "rule", "probability", "verdict"]
    parts = with_parts(pages.drop(*[c for c in pages.columns if c in made]))
    known = parts.withColumn("__f", features(buckets)).withColumn("__w", fit(labelled, buckets).scalar())
    margin = F.aggregate("__f", F.lit(0.0), lambda s, i: s + F.col("__w")[i]) / F.sqrt(F.size("__f").cast("double"))
    verdict = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return (
        known.withColumn("probability", 1 / (1 + F.exp(-margin)))
        .withColumn("rule", rule_of(rules, 0))
        .withColumn("verdict", F.coalesce(rule_of(rules, 1), verdict))
        .drop("__f", "__w")
    )
