from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("CORPUSLAKE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from corpuslake.session import local_session

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
