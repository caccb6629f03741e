import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from braidscan import runtime  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = runtime.build_session(cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    runtime.attach(s)
    yield s
    s.stop()
