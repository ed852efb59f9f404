import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF_CHECK, SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from catalytics.session import get_session
    s = get_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from oracle_harness import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_check():
    from oracle_harness import duck
    return duck(SF_CHECK)
