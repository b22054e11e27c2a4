import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from offerlens.session import build_session

    return build_session(cores="8", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
