"""IO2: balanced slices against counts in Python, for skew, nulls, ties and empty tables."""

import pytest

from facetframe.sources.slices import balanced_slices, cut, slice_sizes

CASES = {
    "even": [(i, i) for i in range(4000)],
    "hot": [(7 if i % 3 == 0 else i, i) for i in range(4000)],
    "nulls": [(None if i % 2 else i, i) for i in range(4000)],
    "all null": [(None, i) for i in range(100)],
    "one value": [(5, i) for i in range(2000)],
    "few values": [(i % 5, i) for i in range(4000)],
    "negative": [(-(i % 50) ** 3, -i) for i in range(4000)],
    "null split": [(7, None if i % 9 == 0 else i) for i in range(2000)],
    "empty": [],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_every_row_in_one_slice(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, "k long, s long")
    slices = balanced_slices(df, "k", "s", 8)
    sizes = slice_sizes(df, slices).collect()
    assert sum(r.rows for r in sizes) == len(rows)
    got = [df.where(s.predicate).count() for s in slices] if name in ("hot", "nulls") else None
    assert got is None or got == [r.rows for r in sizes]
    assert sum(r.rows for r in sizes if r.kind == "null") == sum(k is None for k, _ in rows)
    assert max(r.rows for r in sizes) * 8 <= 2 * len(rows)


def test_cut_spells_out_the_bounds():
    marks = [1, 2, 3, 4, 7, 7, 7, 7, 7, 9, 10]
    got = [(s.kind, s.predicate) for s in cut(marks, 0, 12, 3, "k")]
    assert got == [("range", "k <= 4"), ("range", "k > 4 AND k < 7"),
                   ("value", "k = 7"), ("range", "k > 7"), ("null", "k IS NULL")]
