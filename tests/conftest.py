import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from parley.session import build_session, clean_up  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "parley-tests", spark__sql__shuffle__partitions="4",
                            spark__driver__memory="4g")
    yield session
    clean_up(session)
    session.stop()
