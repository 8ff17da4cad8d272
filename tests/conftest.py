"""One small local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallgrass.session import session

    place = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(place / "checkpoint"),
            "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.driver.host": "127.0.0.1",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
