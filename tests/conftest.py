import pytest

from tallymark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, spark__default__parallelism="4")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
