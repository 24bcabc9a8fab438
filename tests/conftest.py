import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lookout.session import get_spark
    s = get_spark("local[8]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle_compare import duck
    return duck(SF_SMALL)
