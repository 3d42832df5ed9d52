"""Connected components: links merged in each task, the same result by merging alone and by rounds of stars."""

import random

import pytest

from gazeframe.llm import components


def plain(links):
    least = {n: n for link in links for n in link}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def graph(kind):
    rng = random.Random(kind)
    if kind == "chain":
        links = [(i, i + 1) for i in range(60)]
    elif kind == "star":
        links = [(500, i) for i in range(100)] + [(600, 500)]
    elif kind == "sparse":
        links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    else:
        links = [(rng.randrange(50) + 100 * k, rng.randrange(50) + 100 * k) for k in range(4) for _ in range(60)]
    links += links[:10] + [(b, a) for a, b in links[:10]]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("chunk", [1 << 18, 50, 5])
@pytest.mark.parametrize("kind", ["chain", "star", "sparse", "blocks"])
def test_merged_or_in_rounds(spark, monkeypatch, kind, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    links = graph(kind)
    rows = spark.createDataFrame(links + [(7, None), (None, 8)], "a long, b long").repartition(5)
    found = components.components(rows)
    assert found.columns == ["node", "component"]
    made = found.collect()
    want = plain([(a, b) for a, b in links if a != b])
    assert sorted((r.node, r.component) for r in made) == sorted(want.items())


def test_few_links_need_no_rounds(spark, monkeypatch):
    made, written = [], components.written
    monkeypatch.setattr(components, "written", lambda df, purpose: made.append(purpose) or written(df, purpose))
    rows = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(7)
    assert {r.component for r in components.components(rows).collect()} == {0}
    assert len(made) == 2


def test_no_links(spark):
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
