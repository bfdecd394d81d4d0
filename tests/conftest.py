import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from tarn.session import local_session

    session = local_session(cores=int(os.environ.get("TEST_CPUS", "4")), partitions=4)
    yield session
    session.stop()
