import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from tideline.session import local_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()
