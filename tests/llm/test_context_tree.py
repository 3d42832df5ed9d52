"""Context-tree scores against plain versions."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazeframe.llm import context_tree


def test_word_order_counts_in_the_context_tree(spark):
    rng = random.Random(3)
    texts = [" ".join(["red cat", "old dog", "big sun"][rng.randrange(3)] for _ in range(30)) for _ in range(40)]
    words = texts[0].split()
    shuffled = sorted(words)
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(100, " ".join(words), False), (101, " ".join(shuffled), False)]
    made = {r.doc_id: r for r in context_tree.score_running(spark.createDataFrame(rows, "doc_id long, text string, trains boolean"), "trains", bucket_bytes=1500).collect()}
    assert made[100].score > made[101].score + 5 and abs(made[100].base_score - made[101].base_score) < 1e-9
    assert abs(made[100].score - made[0].score) < 1e-9


@pytest.mark.parametrize("depth", [4, 5])
def test_running_context_tree_against_plain_recursion(spark, depth):
    docs = [(1, "abba ab"), (2, "Ab  ba\nab"), (3, "zz ab"), (4, None)]
    df = spark.createDataFrame([(*d, d[0] != 3) for d in docs], "doc_id long, text string, trains boolean")
    made = {r.doc_id: r for r in context_tree.score_running(df, "trains", depth=depth).collect()}

    def letters(text):
        body = b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"
        led = b"\0" * (depth - 1) + b" " + body
        yield from ((tuple(led[i : i + depth]), led[i + depth]) for i in range(len(body)))

    counts = defaultdict(lambda: [0, 0])

    def decisions(byte):
        for j in range(8):
            yield (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1

    for doc, text in docs:
        if doc != 3:
            for context, byte in letters(text):
                for node, bit in decisions(byte):
                    for d in range(depth + 1):
                        counts[context[depth - d :], node][bit] += 1
    children = defaultdict(set)
    for context, node in list(counts):
        if context:
            children[context[1:], node].add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(context, node):
        own = kt(*counts.get((context, node), (0, 0)))
        if len(context) == depth:
            return own
        below = sum(weighted(c, node) for c in children[context, node])
        return math.log(0.5 * math.exp(own) + 0.5 * math.exp(below))

    def one(context, node, d=0):
        here = context[depth - d :] if d else ()
        a, b = counts.get((here, node), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        share = 0.5 * math.exp(kt(a, b) - weighted(here, node))
        return share * p + (1 - share) * one(context, node, d + 1)

    for doc, text in docs:
        total = sum(
            math.log10(p if bit else 1 - p)
            for context, byte in letters(text)
            for node, bit in decisions(byte)
            for p in [one(context, node)]
        )
        assert abs(made[doc].score - total) < 1e-6


def test_long_texts_in_portions(monkeypatch):
    texts = [b"ab cd ef gh ij \n", b"\n", b"xy \n"]
    whole = list(context_tree.running_grams(texts))
    monkeypatch.setattr(context_tree, "PORTION", 4)
    parts = list(context_tree.running_grams(texts))
    assert len(parts) > 1
    for i in range(2):
        assert np.concatenate([p[i] for p in parts]).tolist() == whole[0][i].tolist()


def test_running_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (2, "a b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.col("doc_id") > 1)
    made = context_tree.score_running(df, "t").collect()
    assert len(made) == 5 and all(r.score < 0 for r in made)
    assert context_tree.score_running(df.limit(0), "t").collect() == []


def scores(df, **options):
    made = context_tree.score_running(df, "trains", **options).collect()
    return sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in made)


def test_buckets_and_portions_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, i % 4 > 0) for i, t in enumerate(texts)], "doc_id long, text string, trains boolean")
    whole = scores(df)
    assert scores(df, bucket_bytes=900) == whole
    # What tasks read from this module they read again in the driver's own process.
    docs = pa.RecordBatch.from_arrays(
        [pa.array(range(60)), pa.array([i % 4 > 0 for i in range(60)]), pa.array([t.encode() for t in texts])], ["doc_id", "trains", "text"]
    )
    monkeypatch.setattr(context_tree.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(context_tree, "PACK_BYTES", 600)
    packs = list(context_tree._packs(1 << 30)(iter([docs.slice(0, 20), docs.slice(20)])))
    assert len(packs) > 5

    def counts():
        total = Counter()
        for out in context_tree._bucket_counts(5)(iter(packs)):
            for r in out.to_pylist():
                total[r["word"], r["key"]] += r["n"]
        return total

    plain = counts()
    monkeypatch.setattr(context_tree, "HELD_WORDS", 20)
    monkeypatch.setattr(context_tree, "HELD_GRAMS", 100)
    monkeypatch.setattr(context_tree, "PORTION", 64)
    assert counts() == plain and len(plain) > 500


def test_a_long_text_is_as_its_parts(spark):
    long = "lorem ipsum dolor sit amet " * 200_000
    df = spark.createDataFrame([(1, long, False), (2, long[:27], False), (3, "lorem amet sit", True), (4, None, None)], "doc_id long, text string, trains boolean")
    made = {r.doc_id: r for r in context_tree.score_running(df, "trains").collect()}
    assert made[1].n_tokens == 1_000_001 and made[2].n_tokens == 6 and made[4].n_tokens == 1
    end = made[4].base_score
    assert abs((made[1].base_score - end) - 200_000 * (made[2].base_score - end)) < 1e-3
    # After the first "l" every further copy begins in the same context, and none is better known than another.
    assert 190_000 < made[1].score / made[2].score < 210_000


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", True, 7, 8, 9)], "doc_id long, text string, trains boolean, bucket int, key int, score int")
    made = context_tree.score_running(df, "trains")
    assert made.columns == ["doc_id", "trains", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert made.first().score < 0
