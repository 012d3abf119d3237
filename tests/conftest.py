import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import get_spark
    s = get_spark(app="sitelens-tests", master=os.environ.get("SITELENS_TEST_MASTER", "local[*]"), shuffle_partitions=8, shared=tempfile.mkdtemp(prefix="sitelens-tests-"))
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SMALL
