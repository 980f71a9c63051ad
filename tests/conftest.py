import os

import pytest

from contextquarry.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
