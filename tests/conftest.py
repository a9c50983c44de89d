import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lumbre.session import build_session
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                              "spark.sql.streaming.stateStore.maintenanceInterval": "600s"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def lines(spark):
    def make(*rows):
        return spark.createDataFrame([(r,) for r in rows], "value string")
    return make


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
