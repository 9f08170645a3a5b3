import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomtext.session import build_session

    s = build_session("local[4]", "tests", 4, spark_sql_files_maxPartitionBytes="4m", spark_driver_memory="4g")
    yield s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
