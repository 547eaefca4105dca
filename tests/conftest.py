import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from starweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="2",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


RATING = "user_id string, business_id string, stars double"
PAIR = "user_id string, business_id string"


@pytest.fixture(scope="session")
def golden(spark):
    text = """u1,b1,5 u1,b2,3 u2,b1,4 u2,b2,2 u2,b3,5 u3,b1,3 u3,b2,2 u3,b3,4
              u4,b1,1 u4,b3,5 u5,b2,4 u5,b4,2 u5,b1,2"""
    rows = [(u, b, float(s)) for u, b, s in (row.split(",") for row in text.split())]
    return spark.createDataFrame(rows, RATING)
