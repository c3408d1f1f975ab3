import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

R_EARTH = 6378137.0
SF_SMALL = "/root/testdata/sf0.001"


def hav(lon1, lat1, lon2, lat2):
    """Independent scalar haversine for brute-force checks."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    dphi = math.radians(lat2 - lat1)
    dl = math.radians(lon2 - lon1)
    a = math.sin(dphi / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return R_EARTH * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


@pytest.fixture(scope="session")
def spark():
    from medoidlab.session import local_session

    s = local_session("*", 8, app="medoidlab-tests")
    yield s
    s.stop()


@pytest.fixture
def pts(spark):
    def make(rows):
        from medoidlab.sources.trips import positions_from_rows

        return positions_from_rows(spark, rows)

    return make
