import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from threadlens.session import get_session
    s = get_session("local[8]", 8)
    s.conf.set("threadlens.scanPartitions", "8")  # the test tables hold one row group each
    yield s
    s.stop()
