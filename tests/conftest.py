import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import build_session
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                              "spark.driver.memory": "8g", "spark.sql.autoBroadcastJoinThreshold": "10MB"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
