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
    from parley.session import get_session
    ckpt = tempfile.mkdtemp(prefix="parley-test-ckpt-")
    s = get_session("local[4]", conf={"spark.sql.shuffle.partitions": "8",
                                      "spark.checkpoint.dir": ckpt})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def messages(spark, rows):
    """Flat message rows from (user_id, conversation_id, browser, device, os, status, ts_ms)."""
    from parley import schemas as S
    full = [("b", "d", conv, "n", "", "", user, "", br, dev, os_, "web", st, "", "t", [], [], ts)
            for user, conv, br, dev, os_, st, ts in rows]
    return spark.createDataFrame(full, S.MESSAGE)
