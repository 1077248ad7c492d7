import pytest

from tidewire.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tidewire-tests", master="local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
