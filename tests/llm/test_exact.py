"""Exact duplicates against a dictionary of texts."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazeframe.llm import exact

SCHEMA = "doc_id long, text string, kept string, group_size int"
ROWS = [
    (5, "a text"),
    (3, "a text"),
    (9, "a text"),
    (9, "a text"),
    (None, "a text"),
    (1, None),
    (2, ""),
    (4, " "),
    (6, "é"),
    (7, "é"),
    (None, "no id"),
    (None, "no id"),
    (8, "long " * 200_000),
    (10, "long " * 200_000),
]


def plain(rows, pick):
    texts = Counter(t or "" for _, t in rows)
    stays = {t: pick([i for i, u in rows if (u or "") == t and i is not None], default=None) for t in texts}
    return sorted(
        ((i, stays[t or ""], texts[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr
    )


def check(frame, rows, pick):
    found = frame.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == plain(rows, pick)
    stay = [r for r in found if r.kept]
    assert all(r.doc_id == r.keep_id for r in stay)
    assert sorted(r.text_sha256 for r in stay) == sorted({r.text_sha256 for r in found})


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


@pytest.mark.parametrize("keep,pick", [("least", min), ("largest", max)])
def test_odd_rows(spark, keep, pick):
    """One row of every text stays, also of rows that repeat an id or have none."""
    check(exact.exact_groups(frame(spark, ROWS), keep), ROWS, pick)


@pytest.mark.parametrize("keep,pick", [("least", min), ("largest", max)])
def test_colliding_hashes_are_told_apart_by_their_bytes(spark, keep, pick):
    weak = exact.exact_groups(frame(spark, ROWS), keep, hashed=lambda t: F.substring(F.md5(t.cast("binary")), 1, 1))
    check(weak, ROWS, pick)
    one = exact.exact_groups(frame(spark, ROWS), keep, hashed=lambda t: F.lit("x"))
    check(one, ROWS, pick)


def test_hot_group_and_many_small_ones(spark):
    rows = [(i, "hot") for i in range(900)] + [(1000 + i, f"t{i // 2}") for i in range(1800)]
    check(exact.exact_groups(frame(spark, rows), "largest"), rows, max)


def test_normalised_texts(spark):
    made = exact.exact_groups(frame(spark, [(1, "A  b"), (2, "a b"), (3, "ab")]), normalise=lambda t: F.lower(F.regexp_replace(t, " +", " ")))
    assert {(r.doc_id, r.keep_id) for r in made.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_whole_rows_of_what_stays(spark):
    made = exact.deduplicated(frame(spark, ROWS))
    assert made.columns == ["doc_id", "text", "kept", "group_size"]
    found = made.collect()
    assert {(r.doc_id, r.text) for r in found} == {(3, "a text"), (1, None), (4, " "), (6, "é"), (7, "é"), (None, "no id"), (8, "long " * 200_000)}
    assert len(found) == 7 and {(r.kept, r.group_size) for r in found} == {("clash", 0)}


def test_empty_table(spark):
    assert exact.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_main_path_has_no_python(spark):
    made = exact.exact_groups(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
