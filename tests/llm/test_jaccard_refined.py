"""A large group of the Jaccard join is taken apart without losing a link, and its work does not grow with its square."""

import random

import pytest

from gazeframe.llm import jaccard
from tests.llm.test_jaccard_groups import plain


def passage_texts(sets, seed):
    """Texts of a common passage and as many words of their own, every tenth with a near copy."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(sets):
        words = passage + [f"f{i}w{k}" for k in range(rng.choice([30, 40, 50]))]
        texts.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            words[rng.randrange(len(words))] = "other"
            texts.append((2 * i + 1, " ".join(words)))
    return texts


@pytest.mark.parametrize("length,percent", [(4, 85), (5, 80)])
def test_places_grow_with_the_group(spark, monkeypatch, length, percent):
    links, rows = jaccard._tree_links, []

    def counted(placed, *rest):
        rows.append(placed.count())
        return links(placed, *rest)

    monkeypatch.setattr(jaccard, "_tree_links", counted)
    placed = []
    for sets in (50, 100):
        texts = passage_texts(sets, percent)
        frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
        rows.clear()
        made = jaccard.classes(frame, length=length, percent=percent, slice_rows=6)
        assert {r.doc_id: r.component_id for r in made.collect()} == plain(texts, length, percent)
        placed.append(sum(rows))
    assert placed[0] <= 60
    assert placed[1] <= 120


@pytest.mark.parametrize("length,percent,slice_rows", [(4, 85, 3), (5, 80, 3), (5, 80, 20), (2, 50, 4)])
def test_chains_and_cut_texts_keep_their_links(spark, length, percent, slice_rows):
    rng = random.Random(length * percent)
    texts = []
    for family in range(6):
        words = [f"p{i}" for i in range(40)] + [f"f{family}w{i}" for i in range(rng.choice([20, 60, 100]))]
        for _ in range(25):
            # A step away from the text before, from the first one, or a shorter piece of it.
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            cut = words[: rng.randrange(int(len(words) * 0.7), len(words) + 1)] if rng.random() < 0.4 else words
            texts.append((rng.randrange(10**6), " ".join(cut)))
    texts = list(dict(texts).items())
    want = plain(texts, length, percent)
    frame = spark.createDataFrame(texts + texts[::7], "doc_id long, text string").repartition(5)
    made = jaccard.classes(frame, length=length, percent=percent, slice_rows=slice_rows).collect()
    assert len(made) == len(texts) + len(texts[::7])
    assert {r.doc_id: r.component_id for r in made} == want
