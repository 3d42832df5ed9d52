"""No link is lost in a group that a common passage ties together, cut into small slices."""

import random

import pytest

from gazeframe.llm import jaccard


def plain(texts, length, percent):
    """Smallest id that links lead to, by comparing all sets."""
    sets = {}
    for doc, text in texts:
        words = text.lower().split()
        sets[doc] = {tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()
    label = {doc: doc for doc in sets}
    docs = sorted(sets)
    changed = True
    links = [
        (a, b)
        for i, a in enumerate(docs)
        for b in docs[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("length,percent", [(4, 85), (5, 80)])
def test_common_passage_with_near_copies(spark, length, percent):
    rng = random.Random(percent)
    passage = [f"p{i}" for i in range(60)]
    texts, doc = [], 0
    for family in range(60):
        own = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([5, 12, 40, 90]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            words = passage + own
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append((doc, " ".join(words)))
            doc += 1
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    made = jaccard.classes(frame, length=length, percent=percent, slice_rows=6)
    assert {r.doc_id: r.component_id for r in made.collect()} == plain(texts, length, percent)
