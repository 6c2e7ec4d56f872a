import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from weekwise.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("weekwise-tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
