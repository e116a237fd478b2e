import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobsieve.session import session  # noqa: E402


# Made on import: test modules name columns at module level, which needs a running session.
SPARK = session("tests", "local[4]", {
    "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "jobsieve.spread": "4",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"})
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SPARK
