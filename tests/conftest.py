import pytest

from folioflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
