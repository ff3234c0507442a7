import os

import pytest

os.environ.setdefault("RALLYGRID_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from rallygrid.session import get_session

    session = get_session("tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
