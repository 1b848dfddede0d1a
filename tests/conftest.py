import pytest

from quillwork.session import local_session, shared_dir


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4", "4")
    shared_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
