import pytest

from shelfwise import scale
from shelfwise.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="shelfwise-tests")
    session.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(params=["window", "chunks"])
def running(request, monkeypatch):
    """Run a test with one chunk and with many."""
    if request.param == "chunks":
        monkeypatch.setattr(scale, "CHUNK_ROWS", 9)
    return request.param
