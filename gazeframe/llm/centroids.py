"""Centroid clustering of integer vectors with Spark's own expressions.

Distances are folded by ``zip_with`` and ``aggregate`` against centroids that stand as literal arrays in the
plan; the least of an array of (distance, cluster) structs is the cluster; one sum per component updates the
centroids. Only the centroids, ``clusters`` times ``width`` integers, ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.components import written

WIDTH = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SALT = "3:"
#: Largest component whose squared distances still add up in 64 bits, at up to 64 components.
LARGEST = 1 << 27


def as_integers(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm) of the usable vectors: floor(scale * x) of every component and the sum of its squares."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    floors = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= float(LARGEST))

    fit = (F.size("embedding") == width) & F.forall(x, usable)
    return (
        vectors.where(F.coalesce(fit, F.lit(False)))
        .select("vec_id", floors.alias("v"))
        .withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c))
    )


def first_centroids(whole: DataFrame, clusters: int, salt: str = SALT) -> list[list[int]]:
    """The vectors with the least hashes of salt and id; equal ids go by their components, missing ids last."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    order = [mark.asc_nulls_last(), F.col("v").asc()]
    return [list(row.v) for row in whole.orderBy(*order).limit(clusters).select("v").collect()]


def nearest(centroids: Sequence[Sequence[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid of ``v``; ties go to the smaller number."""

    def squared(number: int, centroid: Sequence[int]) -> Column:
        literal = ", ".join(f"{c}L" for c in centroid)
        dot = f"aggregate(zip_with(v, array({literal}), (a, b) -> a * b), 0L, (s, p) -> s + p)"
        return F.expr(f"struct(norm + {sum(c * c for c in centroid)}L - 2 * {dot} AS distance, {number} AS cluster)")

    return F.array_min(F.array(*[squared(i, c) for i, c in enumerate(centroids)]))


def moved(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of every cluster's vectors; a cluster without vectors keeps its centroid."""
    width = len(centroids[0])
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]
    new = list(centroids)
    for row in assigned.groupBy("near.cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[row.cluster] = [row[f"s{i}"] // row.n for i in range(width)]
    return new


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    salt: str = SALT,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    ``vectors`` needs vec_id and embedding (array of numbers). A vector is usable with exactly ``width`` components,
    none NULL or not finite, and none beyond ``LARGEST`` once scaled, as its distance would not fit 64 bits; others
    have no row. Repeated rows are vectors of their own. A NULL vec_id stays NULL and starts a cluster only if there
    are too few other vectors. With fewer vectors than ``clusters`` each starts one. No usable vector, no row. An
    inertia beyond 64 bits is NULL. Other columns are left out. The work runs when this is called: the integer
    vectors and the last assignment are written to the shared folder, and every round is one pass without a shuffle
    but for its partial sums.
    """
    whole = written(as_integers(vectors, width, scale), "vectors")
    centroids = first_centroids(whole, clusters, salt)
    if not centroids:
        return whole.select(
            "vec_id",
            F.lit(0).alias("cluster"),
            F.lit(0).cast("long").alias("distance"),
            F.lit(0).cast("long").alias("cluster_inertia"),
            F.lit(0).cast("long").alias("inertia"),
            F.lit("").alias("centroid_sha256"),
        )
    for _ in range(rounds):
        centroids = moved(whole.select("v", nearest(centroids).alias("near")), centroids)
    last = written(whole.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.*"), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {row[0]: int(row[1]) for row in last.groupBy("cluster").agg(exact).collect()}

    def chosen(values: list, kind: str) -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]

    def held(value: int) -> int | None:
        return value if value < 1 << 63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return last.select(
        "vec_id",
        "cluster",
        "distance",
        chosen([held(sums.get(i, 0)) for i in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(held(sum(sums.values()))).cast("long").alias("inertia"),
        chosen(digests, "string").alias("centroid_sha256"),
    )
