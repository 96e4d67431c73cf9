"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from docgrid.session import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "8")), "tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
