import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parlance.session import get_session
    s = get_session("local[8]", shuffle_partitions=8, scan_partitions=8, driver_memory="12g")
    yield s
    s.stop()
