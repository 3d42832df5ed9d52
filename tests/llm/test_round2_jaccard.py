"""Rows without id in the Jaccard join."""

from gazeframe.llm import jaccard


def test_rows_without_id_lead_nothing(spark):
    big = 2**60 + 1
    one = " ".join(f"a{i}" for i in range(80))
    near = one.replace("a79", "z")
    other = " ".join(f"b{i}" for i in range(80))
    rows = [(None, one), (None, other), (big, one), (big + 1, near), (7, other), (None, None), (big + 2, None)]
    made = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    by = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in made), key=str)
    assert by == sorted(
        [(True, 0, 77, None)] * 2
        + [(True, 0, 0, None), (False, big, 77, big), (False, big + 1, 77, big), (False, 7, 77, 7), (False, big + 2, 0, big + 2)],
        key=str,
    )
