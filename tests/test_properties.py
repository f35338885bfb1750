"""Properties of the operators on the driver's smallest tables."""

import math

from pyspark.sql import functions as F

from facetframe.operators import distributions as D
from facetframe.operators import paging as PG
from facetframe.plans.orders import order_profile
from tests.conftest import SF_SMALL


def test_profile_properties(spark):
    p = order_profile(spark, SF_SMALL).cache()
    n = p.count()
    assert n > 0 and p.select("imdbid").distinct().count() == n            # one row per title
    h = D.histogram(p, "ratingMl", D.ML_EDGES).collect()
    inside = p.where((F.col("ratingMl") >= 0) & (F.col("ratingMl") < 99)).count()
    assert sum(r.n for r in h) == inside                                    # zero-filled bins cover the range
    b = D.breakdown(p, "dir.race", D.RACES).collect()
    assert sum(r.n for r in b) <= n
    for r in b:
        assert r.share == math.floor(r.n / max(1, n) * 100 + 0.5)           # shares from counts
    dec = D.by_decade(p, p).collect()
    assert sum(r.n for r in dec) == p.where(F.col("year").isNotNull()).count()
    info = PG.page_info(p, 0, 50).first()
    assert info.total == n and info.pages == max(1, -(-n // 50))
    p.unpersist()
