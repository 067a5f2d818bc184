import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_ORACLE = os.environ.get("RENEWLENS_TEST_SF", "/root/testdata/sf0.01")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from renewlens.session import local_session

    s = local_session(8, shuffle_partitions=8, app="renewlens-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    from oracle import duck_connect

    return duck_connect(SF_ORACLE)
