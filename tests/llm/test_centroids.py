"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import pytest

from gazeframe.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, clusters=8, rounds=10, width=64):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]

    def mark(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1])

    cents = [v for _, v in sorted(kept, key=mark)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == k]
            if own:
                cents[k] = [sum(col) // len(own) for col in zip(*own)]
    near = assign()
    inertia = {k: sum(d for d, c in near if c == k) for k in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, near)), key=repr
    )


def made(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def vectors(seed, n, width, spread):
    rng = random.Random(seed)
    return [(i, [rng.choice(spread) + rng.random() / 8 for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("clusters,rounds", [(8, 3), (3, 6)])
def test_clusters_against_plain_integers(spark, clusters, rounds):
    rows = vectors(clusters, 120, 6, [-0.5, 0.0, 0.5])
    frame = centroids.clustered(spark.createDataFrame(rows, SCHEMA), clusters=clusters, rounds=rounds, width=6)
    assert made(frame) == plain(rows, clusters, rounds, 6)


def test_unusable_vectors_ties_and_repeated_rows(spark):
    """NULL, short, not finite and over-large vectors have no row; ties go to the smaller cluster; copies all count."""
    good = [(i, [float(i % 3), 0.0]) for i in range(9)] + [(4, [1.0, 0.0])] * 30 + [(None, [0.5, 0.25])]
    bad = [(50, None), (51, [1.0]), (52, [1.0, None]), (53, [float("nan"), 0.0]), (54, [float("inf"), 0.0]), (55, [1e30, 0.0]), (56, [])]
    rows = [(*r, 7) for r in good + bad]
    frame = spark.createDataFrame(rows, SCHEMA + ", cluster int")
    assert made(centroids.clustered(frame, clusters=2, rounds=2, width=2)) == plain(good, 2, 2, 2)


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, -1.0])]
    assert made(centroids.clustered(spark.createDataFrame(rows, SCHEMA), rounds=1, width=2)) == plain(rows, 8, 1, 2)


def test_empty_table(spark):
    found = centroids.clustered(spark.createDataFrame([], SCHEMA))
    assert found.columns == COLUMNS and found.collect() == []


def test_floats_are_widened_before_they_are_scaled(spark):
    frame = spark.createDataFrame([(1, [-0.0001, 0.1])], "vec_id long, embedding array<float>")
    assert centroids.as_integers(frame, width=2).collect()[0].v == [-1, 102]
