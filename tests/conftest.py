import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gitquarry.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()
