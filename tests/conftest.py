import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from folia.session import build_session

    session = build_session("local[4]", "folia-tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("FOLIA_TEST_DATA", "/root/testdata/sf0.001")
