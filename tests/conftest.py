import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewise.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="tidewise-tests")
    yield s


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows and a DDL schema string."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
