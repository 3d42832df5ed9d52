"""Sets without a partner leave the join before keys are made, and texts are not shuffled to find the others."""

import random

import pytest
from pyspark.sql import functions as F

from gazeframe.llm import jaccard


@pytest.mark.parametrize("length,percent", [(4, 85), (5, 80)])
def test_only_sets_that_can_have_a_partner_are_left(spark, monkeypatch, length, percent):
    rng = random.Random(length)
    texts = [(10 * i, " ".join(f"w{rng.randrange(30_000)}" for _ in range(200))) for i in range(120)]
    for doc, text in texts[:12]:
        words = text.split()
        words[rng.randrange(200)] = "other"
        texts.append((doc + 1, " ".join(words)))
    texts.append((7, texts[50][1]))
    kept, written = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, purpose, **o: kept.setdefault(purpose, written(df, purpose, **o)))
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    made = {r.doc_id: r.component_id for r in jaccard.classes(frame, length=length, percent=percent).collect()}
    want = {doc: doc for doc, _ in texts}
    want |= {10 * i + 1: 10 * i for i in range(12)} | {500: 7}
    assert made == want
    left = {r.doc_id for r in kept["texts"].select("doc_id").collect()}
    assert {10 * i + k for i in range(12) for k in (0, 1)} <= left
    assert len(left) < 40


def test_marks_lose_no_id(spark):
    ids = [-(2**63), -1, 0, 1, 2**31, 2**62, 2**63 - 1] + [i * 7919 for i in range(3000)]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    docs = frame.unionByName(spark.range(1000).select((F.col("id") * 7919 + 3).alias("doc_id")))
    found = {r.doc_id for r in jaccard._among(docs, frame).collect()}
    assert set(ids) <= found
    assert len(found) < len(set(ids)) + 20
