import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tickerloom.session import local_session

    return local_session(cpus=4, partitions=4, app="tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
