import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerline.session import build_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="ledgerline-tests-")
    s = build_session(
        "local[*]", 8, "ledgerline-tests",
        extra={"spark.checkpoint.dir": f"{scratch}/checkpoint",
               "spark.sql.warehouse.dir": f"{scratch}/warehouse"},
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def sf01():
    return f"{TESTDATA}/sf0.01"
