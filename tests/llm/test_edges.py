"""Every operator on NULLs, empty and very long texts, repeated rows, an empty table and clashing columns."""

import pytest
from pyspark.sql import functions as F

from gazeframe.llm import (
    context_tree,
    fingerprint,
    jaccard,
    language,
    mixing,
    packing,
    private,
    quality,
    token_rows,
    urls,
)
from gazeframe.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, block string, component_id string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def rows():
    plain = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals of the forest today"
    body = [
        (1, plain, "en", "a"),
        (1, plain, "en", "a"),
        (2, plain, "en", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \n\t ", "en", "b"),
        (6, LONG, "en", "b"),
        (7, "12 !? 34", "en", "b"),
        (None, plain + " twice", "en", "b"),
        (None, None, None, None),
        (8, "x", "en", "a"),
        (9, "x", "en", "a"),
    ]
    return [(*r, 0, "clash", "clash", "clash") for r in body]


OPERATORS = {
    "quality": lambda d: quality.assess(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))),
    "mixing": lambda d: mixing.mixture(d, keep_all=True),
    "jaccard": lambda d: jaccard.classes(d),
    "language": lambda d: language.identify(d, language.sample(d), ["doc_id"]),
    "urls": lambda d: urls.judge(d.withColumn("url", F.col("text")).withColumn("host", F.lit(1)), urls.labelled_urls(d.sparkSession)),
    "packing": lambda d: packing.pack_documents(d, default_path(), length=64),
    "private": lambda d: private.protect(d, "k"),
    "context_tree": lambda d: context_tree.score_running(d.withColumn("t", F.col("doc_id") > 1), "t"),
    "fingerprint": lambda d: fingerprint.edited(d),
    "token_rows": lambda d: token_rows.packed_rows(d, default_path(), length=64),
}
PER_ROW = {"quality", "jaccard", "language", "urls", "private", "context_tree", "fingerprint"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    made = OPERATORS[name](spark.createDataFrame(rows(), SCHEMA)).collect()
    if name in PER_ROW:
        assert len(made) == len(rows())
    else:
        assert made
    if name == "jaccard":
        by = [(r.doc_id, r.n_shingles, r.component_id) for r in made]
        assert {c for d, _, c in by if d in (1, 2)} == {1} and {c for d, _, c in by if d in (8, 9)} == {8}
        assert {(n, c) for d, n, c in by if d in (3, 4, 5)} == {(0, 3), (0, 4), (0, 5)}
    if name == "quality":
        assert not any(r.kept for r in made if r.doc_id in (3, 4, 5))
    if name == "language":
        assert {r.lang_pred for r in made if r.doc_id in (3, 4, 5, 7)} == {"und"}
    if name == "context_tree":
        assert {r.n_tokens for r in made if r.doc_id in (3, 4, 5)} == {1}
        assert all(r.score < 0 for r in made)
    if name == "mixing":
        assert {r.doc_id for r in made} == {r[0] for r in rows()}
    if name == "fingerprint":
        assert sum(r.near_next == 1.0 for r in made if r.doc_id in (1, 2)) >= 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []
