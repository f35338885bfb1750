"""Whole jobs: cases where a registered query once did less than all of its work."""

from facetframe.plans import analogues
from tests.conftest import SF_PARITY


def test_profile_by_title_is_whole_and_sorted(spark):
    whole = analogues.QUERIES["order_profile"](spark, SF_PARITY)
    got = analogues.QUERIES["profile_by_title"](spark, SF_PARITY)
    rows = got.collect()
    assert got.columns == whole.columns and len(rows) == whole.count() > 1000
    titles = [r.title for r in rows]
    assert titles == sorted(titles, key=lambda t: (t is None, (t or "").encode()))
