import pytest

from plumbline.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("local[4]", spark__sql__shuffle__partitions="4")
