import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_PARITY = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from facetframe.session import get_spark
    s = get_spark("local[4]", app="facetframe-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def films(spark):
    from tests.film_fixtures import film_frames
    return film_frames(spark)


@pytest.fixture(scope="session")
def film_profile(films):
    from facetframe.plans.films import film_profile
    return film_profile(films).cache()


@pytest.fixture(scope="session")
def gazetteer(spark):
    return spark.read.option("header", True).schema(
        "name string, loc_type string, source string, priority int").csv(
        os.path.join(ROOT, "tests", "data", "seed_gazetteer.csv"))
