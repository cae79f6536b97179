import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quern.session import build_session

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = build_session(
        "tests", "local[4]", 4, spark__checkpoint__dir=f"file://{scratch}/shared", spark__local__dir=f"{scratch}/local", spark__sql__warehouse__dir=f"{scratch}/wh", spark__driver__memory="4g"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL
